"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. A block is described by its word count and link density, those of the
blocks before and after it, and by what the markup around it says, mark by mark (a heading, a list item; inside an
article, a navigation, header, footer, sidebar, notice, advert, form, sharing or comments element, and whether that lies
inside the article or around it; whether other text lies in an article or content element, and if none does, the share of
the page's words that the least such element holds). No mark decides by itself: a decision tree, trained on a small labelled table of pages, weighs them all and keeps or drops each block.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, chunks

# HTML element names by their part in a page, and words of class, id and role that mark containers.
RAW_TEXT = frozenset("script style textarea title iframe".split())
SKIPPED = RAW_TEXT | frozenset("noscript template svg canvas select datalist head".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section
summary table tbody td tfoot th thead tr ul""".split())
CONTAINERS = BLOCKS - frozenset("hr p h1 h2 h3 h4 h5 h6 li dt dd td th tr option".split())
ITEMS = frozenset("li dt dd td th caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Kinds of marks, each with its elements and its words of class, id and role.
KINDS = {
    "article": ("article main", ""),
    "content": ("", "article content post entry story body main text"),
    "navigation": ("nav menu search button", "nav navbar navigation menu breadcrumb breadcrumbs toolbar skip pagination pager search"),
    "header": ("header", "header masthead topbar banner"),
    "footer": ("footer", "footer contentinfo"),
    "sidebar": ("aside", "sidebar side rail widget complementary related recommended"),
    "notice": ("dialog", "cookie cookies consent gdpr notice notices alert popup modal overlay"),
    "advert": ("", "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion"),
    "form": ("form fieldset", "form subscribe newsletter signup login"),
    "sharing": ("", "share sharing social"),
    "comments": ("", "comment comments discussion disqus reply replies respond"),
    "hidden": ("", "hidden"),
}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^<>"']|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*>?|[^<]+|<""", re.S)
#: Raw text holds no tags: it ends at its own end tag only.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW_TEXT}
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_MAIN_ROLE = re.compile(r"""\srole\s*=\s*["']?main\b""", re.I)
_BY_TAG = {tag: kind for kind, (tags, _) in KINDS.items() for tag in tags.split()}
_BY_WORD = {word: kind for kind, (_, words) in KINDS.items() for word in words.split()}
_HIDDEN = re.compile(r"\shidden[\s>=]|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: First and last parts of class names that say what an element has or may do, not what it is.
MODIFIERS_FIRST, MODIFIERS_LAST = frozenset("has with without no".split()), frozenset("enabled disabled".split())
#: Elements whose end tag may be left out, and those whose start ends them.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}} | {"td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    text: str
    words: int
    link_words: int
    heading: bool
    item: bool
    #: The marked elements around the block from the outermost in: (kind, number of the element).
    marks: tuple[tuple[str, int], ...]


def _words_of_marks(tag: str) -> set[str]:
    """Words of a tag's class, id and role."""
    names = (_PART.findall(n) for m in _MARKS.finditer(tag) for n in (m[1] or m[2] or m[3] or "").split())
    return {w.lower() for parts in names if parts and parts[0].lower() not in MODIFIERS_FIRST and parts[-1].lower() not in MODIFIERS_LAST for w in parts}


def _kinds(name: str, tag: str) -> set[str]:
    """The kinds of marks that a start tag carries; html and body carry none."""
    if name in ("html", "body"):
        return set()
    found = {_BY_TAG[name]} if name in _BY_TAG else set()
    if "=" in tag or "hidden" in tag:
        found |= {_BY_WORD[w] for w in _words_of_marks(tag) if w in _BY_WORD}
        if _MAIN_ROLE.search(tag):
            found = found - {"content"} | {"article"}
        if _HIDDEN.search(tag):
            found.add("hidden")
    return found


def _tokens(page: str) -> Iterator[tuple[str, str]]:
    """Tags, comments and text of a page in order, with the lower-case names of tags; raw text is left out where it ends."""
    at, endless = 0, set()
    while at < len(page):
        for m in _TOKEN.finditer(page, at):
            token = m[0]
            named = _NAME.match(token) if token[0] == "<" else None
            name = named[1].lower() if named else ""
            yield token, name
            if name in RAW_TEXT and token[1] != "/" and not token.endswith("/>") and name not in endless:
                end = _RAW_END[name].search(page, m.end())
                if end:
                    at = end.start()
                    break
                endless.add(name)
        else:
            return


def blocks_of(page: str) -> list[Block]:
    """Flat text blocks of a whole page in order."""
    out: list[Block] = []
    #: Open elements, each with the marks around it.
    open_: list[tuple[str, tuple]] = []
    marks, in_link, skip, within, elements = (), 0, "", "", 0
    texts: list[str] = []
    links: list[str] = []

    def close() -> None:
        if texts:
            words = " ".join("".join(texts).split())
            if words:
                n = words.count(" ") + 1
                out.append(Block(words, n, min(len("".join(links).split()), n), within in HEADINGS, within in ITEMS, marks))
            texts.clear()
            links.clear()

    for token, name in _tokens(page):
        if skip:
            if name == skip and token[1] == "/":
                skip = ""
            elif not (skip == "head" and name == "body"):
                continue
            else:
                skip = ""
        if not name:
            if token[0] != "<" or token == "<":
                text = html_lib.unescape(token) if "&" in token else token
                texts.append(text)
                if in_link:
                    links.append(text)
            continue
        ends = token[1] == "/"
        if name in SKIPPED:
            if not ends and not token.endswith("/>"):
                skip = name
            texts.append(" ")
        elif name == "a":
            in_link = 0 if ends else 1
            links.append(" ")
        elif name == "br":
            texts.append(" ")
        elif name in BLOCKS or name == "button":
            close()
            within = "" if ends else name
            in_link = in_link if name not in CONTAINERS else 0
            while not ends and open_ and name in ENDED_BY.get(open_[-1][0], ()):
                marks = open_.pop()[1]
            kinds = () if ends or name == "hr" else sorted(_kinds(name, token))
            if name in CONTAINERS or name == "button":
                if not ends:
                    open_.append((name, marks))
                elif any(n == name for n, _ in open_):
                    while open_:
                        n, marks = open_.pop()
                        if n == name:
                            break
            elif kinds:
                open_.append((name, marks))
            elif ends and open_ and open_[-1][0] == name:
                marks = open_.pop()[1]
            if kinds:
                elements += 1
                marks += tuple((kind, elements) for kind in kinds)
    close()
    return out


MARKS = tuple(KINDS)
#: Kinds that say where the main text is; the others say where it isn't.
MAIN = ("article", "content")
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "item", *MARKS, "share", "beside")


def features(blocks: Sequence[Block]) -> np.ndarray:
    """The blocks of one page to rows of FEATURES.

    Beyond the page's ends there are no words and no links. A mark is 0 where no element of its kind is around the
    block, 2 where the innermost one lies inside an article element, else 1; an article or content element is 1. share: 0
    without an element of another kind around the block; 1 where article or content text lies outside one of these; else 1 and
    the part of the page's words inside the one that holds least. So comments or a sidebar gain nothing by outweighing
    the article, while a form or widget that holds the whole page does. beside: 1 where the block is in no article or content
    element and other text is.
    """
    a = np.array([(b.words, b.link_words / b.words) for b in blocks], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, a[:-1]])[: len(a)], np.vstack([a[1:], edge])[-len(a) :] if len(a) else np.zeros((0, 2))
    held: dict[int, int] = {}
    main_held: dict[int, int] = {}
    is_main = [any(kind in MAIN for kind, _ in b.marks) for b in blocks]
    for b, main in zip(blocks, is_main):
        for element in {element for _, element in b.marks}:
            held[element] = held.get(element, 0) + b.words
            main_held[element] = main_held.get(element, 0) + b.words * main
    total, main_total = sum(b.words for b in blocks), sum(b.words for b, main in zip(blocks, is_main) if main)
    told = np.zeros((len(blocks), 4 + len(MARKS)))
    for row, b, main in zip(told, blocks, is_main):
        row[:2] = b.heading, b.item
        inside, others = 1, []
        for kind, element in b.marks:
            own = kind in MAIN
            row[2 + MARKS.index(kind)] = 1 if own else inside
            inside = 2 if kind == "article" else inside
            others += [] if own else [element]
        rival = any(main_total > main_held[e] for e in others)
        row[-2] = 0 if not others else 1 if rival else 1 + min(held[e] for e in others) / total
        row[-1] = main_total > 0 and not main
    return np.hstack([a, before, after, told])


# The labelled table: pages in short. +n is a block of n words that is main text, -n one that isn't, followed by Lm if m
# of the words are linked.
LABELLED = (
    # A marked article among marked parts; long and short blocks on both sides.
    "<nav><ul><li>-1L1<li>-2L2<li>-1L1</ul></nav><div class=ad>-9</div><article><h1>+8</h1><p>+6<p>+60<p>+1<p>+140L2<p>+3</article><footer>-12</footer>",
    "<header>-2L2<p>-40</header><main><h1>+5</h1><p>+1<p>+1<p>+25L3<h2>+2</h2><p>+90</main><aside><p>-30<p>-14L1</aside><footer><p>-80</footer>",
    "<header><h1>-3</h1></header><nav>-4L4</nav><article><header><h1>+7</h1><p>+5</header><p>+45<ul><li>+3L3<li>+6L6<li>+2L2</ul><p>+70L5<footer>-6</footer></article><footer>-25L4</footer>",
    "<article><p>+50<aside><p>-35</aside><p>+64<div class=ad>-20</div><p>+8<div class=share>-2L2</div><div class=related>-9L9<p>-40</div><section class=comments><h2>-1</h2><p>-55<p>-90<p>-4</section></article>",
    "<article><h1>+9</h1><p>+30<form>-2<p>-12<p>-40</form><p>+75<div class=notice>-16</div><div class=cookie-consent><p>-60</div><p>+2</article><div class=comments><p>-70<p>-5</div>",
    "<article><p>+1</article>", "<article><ul><li>+4L4<li>+12L1<li>+1</ul></article>", "<article><h2>+2</h2><p>+10L10<p>+3L3</article>",
    "<article><p>+30<ul><li>+3L3<li>+2L2</ul><p>+4</article>", "<article><p>+1<p>+5L5<p>+3<p>+6L6<p>+2</article>", "<nav>-1L1</nav><article><p>+4<p>+9<ul><li>+2L2<li>+2</ul><p>+7L7</article>",
    "<nav>-40</nav><article><p>+20</article><div class=notice><p>-45</div><div class=sponsored><p>-50</div><div class=newsletter><p>-30</div>",
    "<article><p>+15<div class=newsletter><p>-25</div><nav>-3L3<p>-18</nav><p>+22<p hidden>-30<div class=social>-10</div><div class=advert><p>-60</div></article>",
    "<nav><h2>-1</h2><p>-20</nav><main><h1>+4</h1><p>+33<table><tr><td>+2<td>+1<td>+3L3</table><p>+5</main><aside><h3>-2</h3><ul><li>-7L7<li>-6L6</ul></aside>",
    "<div class=modal><p>-28</div><aside><article><h3>-6L6</h3><p>-22</article></aside><article><h1>+6</h1><p>+48</article><footer><article>-15</article></footer>",
    # Classes that name the content: menus may stand in it too.
    "<div class=nav>-1L1<p>-1L1</div><div class=content><h1>+6</h1><p>+40<p>+7<p>+85L4<ul><li>+9<li>+14</ul></div><div class=sidebar>-3L3<p>-33</div><div class=footer>-10</div>",
    "<div class=content><ul><li>-1L1<li>-2L2<li>-1L1<li>-2L2</ul><h1>+5</h1><p>+55<p>+4<p>+38<div class=comments><p>-44</div><ul><li>-3L3<li>-2L2</ul></div>",
    "<div class=post><h2>+4</h2><p>+3<p>+66<p>+2<div class=share>-4L4</div><div class=comment><p>-58</div></div><div class=widget>-2<p>-8L8</div>",
    "<div id=main><p>+12<p>+31<div class=promo>-13</div><p>+29<h2>+3</h2><p>+47</div><div class=banner>-6</div>",
    # No mark at all, or few: words and links of a block and its neighbours tell.
    "<div>-1L1</div><div>-1L1</div><div>-2L2</div><div>-1L1</div><h1>+9</h1><p>+80L1<p>+45<p>+120L4<div>-6L5</div><div>-4L4</div><div>-9L3</div>",
    "<div>-3L3</div><div>-2L2</div><h1>+7</h1><p>+33<p>+18<p>+64L2<p>+11<p>+52<div>-5L2</div><div>-3L3</div><div>-8L6</div>",
    "<ul><li>-1L1<li>-2L2<li>-1L1</ul><p>+22<p>+150<p>+2<p>+70<ul><li>-2L2<li>-1L1<li>-3L3</ul>",
    "<ul><li>-1L1<li>-2L2</ul><p>+120", "<h1>+5</h1><p>+30<p>+8L6<p>+45", "<div>-2L2</div><p>+38", "<div>-6L6</div><p>+80<p>+44<div>-4L4</div>",
    "<div>-9L8</div><h1>+6</h1><div>-3L3</div><p>+70<div>-12L10</div><p>+58<div>-5L5</div>",
    "<p>+200", "<p>+3", "<p>+6<p>+35", "<h1>+5</h1><p>+4<p>+28", "<div>-3L3</div><div>-2L2</div>", "<p>+40L3<p>+5<p>+26<ul><li>+9<li>+12<li>+5</ul><p>+31",
    "<nav>-2L2</nav><h1>+6</h1><p>+58<p>+16L2<p>+3<p>+77<footer>-9</footer>", "<div>-2L2</div><div>-4L4</div><div>+50</div><div>+30</div><div>-1L1</div>",
    "<div>-4</div><div>-1L1</div><div>-2L2</div><h1>+8</h1><p>+70<p>+42<p>+6<p>+55<div>-2</div><div>-6L6</div><div>-7L7</div><div>-10</div>",
    "<ul><li>-1L1<li>-1L1<li>-1L1</ul><div>-9</div><h1>+10</h1><p>+30<p>+44<div>-3L3</div><div>-8</div>",
    "<ul><li>-2L2<li>-1L1</ul><div>-12</div><h2>+6</h2><p>+90<p>+5<p>+61<p>-3<ul><li>-8L8<li>-5L5</ul>", "<div>-3</div><ul><li>-2L2<li>-2L2</ul><p>+58<p>+35<div>-1L1</div><div>-5</div>",
    # A form, a widget or another element that holds the page rather than a part of it.
    "<form><nav>-1L1</nav><h1>+6</h1><p>+50<p>+45<p>+4<footer>-5</footer></form>", "<form><div>-2L2</div><div>-1L1</div><p>+60<p>+3<p>+72L3<div>-3L3</div></form>",
    "<form><main><h1>+7</h1><p>+40<p>+6<p>+52</main>-1</form>", "<div class=widget><p>+64<p>+5<p>+48</div>", "<div class=sidebar><h1>+4</h1><p>+55<p>+70L2</div>",
    "<div class=banner><p>+45<p>+9<p>+62</div>", "<div class=notice><p>-10</div>", "<div class=cookie>-8</div>", "<form>-1<p>-3</form><p>+44<p>+53",
    # Comments, sidebars and the like that outweigh the article beside or around them.
    "<article><p>+40<section class=comments><p>-60<p>-60<p>-60<p>-60<p>-60<p>-60</section></article>", "<article><h1>+4</h1><p>+40</article><section class=comments><p>-60<p>-60<p>-60<p>-60<p>-60<p>-60</section>",
    "<main><p>+60</main><aside><p>-500</aside>", "<div class=content><h1>+5</h1><p>+30<p>+18</div><div class=sidebar><p>-300<p>-120L4</div>", "<article><p>+25<div class=comment><p>-90</div><div class=comment><p>-140</div><div class=comment><p>-6</div></article>",
    "<article><p>+22</article><div class=newsletter><p>-80<p>-45</div><div class=cookie><p>-150</div>", "<article><p>+35</article><div class=related><p>-90<p>-70<p>-85L3</div><footer><p>-200</footer>",
    "<main><p>+18<p>+9</main><div class=ads><p>-60<p>-75</div><div class=comments><h3>-2</h3><div>-80</div><div>-3</div></div>", "<section class=comments><h2>-1</h2><p>-38<p>-61<p>-4</section>", "<h1>+5</h1><p>+30<div class=comments><p>-120<p>-90<p>-85</div>",
    "<div class=post><p>+33<p>+21</div><ul class=comments><li>-44<li>-61<li>-2L1<li>-95</ul><div class=widget>-60</div>",
    # Tables of data, with and without marks around them.
    "<article><p>+30<table><caption>+4</caption><tr><th>+1<th>+2<tr><td>+1<td>+3<tr><td>+2<td>+1L1</table><p>+25</article>", "<p>+40<table><tr><td>+1<td>+2<td>+1<tr><td>+3<td>+1<td>+2</table><p>+33", "<h1>+6</h1><table><tr><th>+2<th>+1<tr><td>+4<td>+2<tr><td>+1<td>+6</table><p>+50",
    "<table><tr><td>-1L1<td>-2L2<td>-1L1</table><h1>+7</h1><p>+64<p>+41<table><tr><td>-2L2<td>-1L1</table>", "<table><tr><td>+2<td>+1<td>+2<tr><td>+3<td>+1<td>+1</table><p>+28",
    "<aside><p>-6</aside>", "<p>+30<div class=ads><p>-40</div><p>+36", "<h1>+5</h1><p>+41<section class=comments><p>-38<p>-3<p>-61</section>",
)


def labelled_blocks(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a page of the labelled table and whether each is main text."""
    word = {"+": "k", "-": "d"}
    spelled = re.compile(r"([+-])(\d+)(?:L(\d+))?")

    def spell(m: re.Match) -> str:
        n, linked = int(m[2]), int(m[3] or 0)
        return " ".join([word[m[1]]] * (n - linked)) + (" <a href=x>" + " ".join([word[m[1]]] * linked) + "</a>" if linked else "")

    blocks = blocks_of(spelled.sub(spell, page))
    return blocks, np.array([b.text[0] == "k" for b in blocks], float)


class Tree(NamedTuple):
    """A node: feature < cut goes to below, else to above; a leaf has a verdict."""

    keep: bool
    feature: int = -1
    cut: float = 0.0
    below: Tree | None = None
    above: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.keep)
        low = x[:, self.feature] < self.cut
        return np.where(low, self.below.predict(x), self.above.predict(x))


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 24, least: int = 1) -> Tree:
    """CART by Gini impurity; ties go to the earlier feature and the lower cut."""
    keep = bool(y.mean() >= 0.5)
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return Tree(keep)
    best = (1e-12, -1, 0.0)
    impurity = lambda v: len(v) * v.mean() * (1 - v.mean())
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            if least <= low.sum() <= len(y) - least:
                gain = impurity(y) - impurity(y[low]) - impurity(y[~low])
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    _, f, cut = best
    if f < 0:
        return Tree(keep)
    low = x[:, f] < cut
    return Tree(keep, f, float(cut), fit_tree(x[low], y[low], depth - 1, least), fit_tree(x[~low], y[~low], depth - 1, least))


def train_tree(labelled=LABELLED) -> Tree:
    pages = [labelled_blocks(page) for page in labelled]
    return fit_tree(np.vstack([features(blocks) for blocks, _ in pages]), np.concatenate([kept for _, kept in pages]))


def main_text(page: str, tree: Tree) -> str:
    found = blocks_of(page)
    keep = tree.predict(features(found)) if found else ()
    return "\n".join(b.text for b, k in zip(found, keep) if k)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in chunks(batches, 2):
            texts = [main_text((page or b"").decode(), tree) for _, _, page in held]
            yield batch(_OUT, [i for i, _, _ in held], [u for _, u, _ in held], texts, [len(t) for t in texts])

    return run


def extract_text(pages: DataFrame, labelled=LABELLED) -> DataFrame:
    """page_id, url, text, n_chars of each row.

    Null and empty html, and pages of which no block is kept, have an empty text. Whole pages are read, unclosed and
    broken tags included; characters are decoded once. Repeated rows and null ids or urls pass through; an empty
    table gives no rows; further columns are not read.
    """
    columns = (F.col("page_id").cast("long").alias("page_id"), "url", F.encode("html", "UTF-8").alias("html"))
    return pages.select(*columns).mapInArrow(_extract(train_tree(labelled)), "page_id long, url string, text string, n_chars long")

import numpy as np

from tendergrid.llm.html_text import FEATURES, KINDS, LABELLED, blocks_of, extract_text, features, fit_tree, labelled_blocks, main_text, train_tree

TREE = train_tree()
PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Home</a> The Site</header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy now, buy a lot of it now.</div>
<article><h1>Head&shy;line &lt;one&gt;</h1><p><b>First   para&nbsp;graph<br><p>Second &amp;amp; last.</p><p>Ok.</p><div class="share"><a href=x>Share</a></div><form><input><label>Mail</label><p>Subscribe to us</p></form>
<p>a < b and c</p><section id="comments"><h2>Comments</h2><p>A long comment by some reader that goes on and on for many words.</p></section></article>
<aside><p>Related things you may like to read some day.</p></aside><div class='cookie-notice'>We use cookies.</div><footer>&copy; 2024 &middot; Site</footer>"""


def test_page():
    assert main_text(PAGE, TREE) == "Head\xadline <one>\nFirst para graph\nSecond &amp; last.\nOk.\na < b and c"


def test_pages_without_marks():
    page = "<body><div><a href=1>One</a></div><div><a href=2>Two</a> <a href=3>Three</a></div><div>" + "<p>" + "word " * 50 + "</p>" * 1 + "<p>" + "more text " * 30 + "</div><div><a href=4>Terms</a></div>"
    assert main_text(page, TREE) == ("word " * 50).strip() + "\n" + ("more text " * 30).strip()


def test_broken_pages():
    for page in ("", "<", "<p", "<p class='x", "plain words only", "<script>never closed <p>x", "<!-- open", "<b>&", "</div></p></body>", "<p>a" * 2000, "<div " * 500, '<a href="' * 300, "퟿\U0001f600<p>&#x1F600;</p>"):
        assert isinstance(main_text(page, TREE), str)
    assert main_text("plain words only", TREE) == "plain words only"
    assert main_text("<article><p>x</p></article>", TREE) == "x"


def test_raw_text_ends_at_its_own_end_tag():
    scripts = ("for(i=0;i<n;i++){s='it';}", "if(a<b&&c", "x='<!--'", 'y="</p><p>no</p><!--"', "z='</head><body>'", "a<b'", 'document.write("<script src=x><\\/script>")', "</scripts>")
    for raw in scripts:
        for tag in ("script", "style", "textarea"):
            block = f"<{tag} type='x'>{raw}</{tag.upper()} >"
            assert main_text(f"<article><p>One.</p>{block}<p>Two.</p></article>", TREE) == "One.\nTwo.", block
            page = f"<head>{block}<title>a<b</title></head><body><article><p>One.</p></article><script>{raw}</script>"
            assert main_text(page, TREE) == "One.", page
    assert main_text("<article><p>One.</p><svg><title>a<b</title><path/></svg><p>Two.</p></article>", TREE) == "One.\nTwo."
    assert main_text("<head><title>never closed<body><article><p>One.</p></article>", TREE) == "One."


def test_marks_that_are_no_boilerplate():
    long = [" ".join(f"{w}{i}" for i in range(50)) for w in ("one", "two")]
    text, ps = "\n".join(long), "".join(f"<p>{t}</p>" for t in long)
    for page in (
        f"<div class='content has-sidebar'>{ps}</div>",
        f"<article class='post share-enabled'>{ps}</article>",
        f"<div class='page with-comments no-footer'>{ps}</div>",
        f"<form id='aspnetForm' action='x'><nav><a>Home</a></nav><div>{ps}</div><footer>Site</footer></form>",
        f"<form id='form1'><nav><a>Home</a></nav><main>{ps}</main></form>",
        f"<form><div role='main'>{ps}</div><label>Mail</label></form>",
        f"<div class='widget'>{ps}</div>",
    ):
        assert main_text(f"<body>{page}", TREE) == text, page
    assert main_text("<div class='cookie-notice'>We use cookies on these pages and like it.</div>", TREE) == ""


def test_end_tags_left_out():
    assert main_text("<article><p>One.<p class='ad'>Buy.<p>Two.<p id=share>Share.<div>Three.</div></article>", TREE) == "One.\nTwo.\nThree."
    assert main_text("<article><ul><li>One.<li class='share'>Share.<p>It.</p><li>Two.</ul><dl><dt class=ad>Buy.<dd>Three.</dl></article>", TREE) == "One.\nTwo.\nThree."
    assert main_text("<article><table><tr><td class=ad>Buy.<td>One.<tr class=promo><td>Buy.<tr><td>Two.</table></article>", TREE) == "One.\nTwo."


def test_formulas_and_fallbacks_are_text():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be. <object data=a>A chart.</object> <video src=b>A film.</video> <audio src=c>A song.</audio></p></article>"
    assert main_text(page, TREE) == "Let x=1 be. A chart. A film. A song."


def table():
    pages = [labelled_blocks(page) for page in LABELLED]
    return [features(blocks) for blocks, _ in pages], [kept for _, kept in pages]


def test_tree_fits_its_table_and_held_out_pages():
    xs, ys = table()
    assert (TREE.predict(np.vstack(xs)) == np.concatenate(ys).astype(bool)).all()
    right = total = 0
    for i in range(len(xs)):
        tree = fit_tree(np.vstack(xs[:i] + xs[i + 1 :]), np.concatenate(ys[:i] + ys[i + 1 :]))
        right, total = right + (tree.predict(xs[i]) == ys[i].astype(bool)).sum(), total + len(ys[i])
    assert right / total > 0.85


def brute_tree(x, y, depth=24):
    """The tree by its definition, over Python lists: verdict of one row."""
    if depth == 0 or len(y) < 2 or len(set(y)) == 1:
        return lambda row, k=sum(y) * 2 >= len(y): k
    gini = lambda v: len(v) * (sum(v) / len(v)) * (1 - sum(v) / len(v))
    best = (1e-12, None, None)
    for f in range(len(x[0])):
        values = sorted({row[f] for row in x})
        for cut in ((a + b) / 2 for a, b in zip(values, values[1:])):
            low, high = [v for row, v in zip(x, y) if row[f] < cut], [v for row, v in zip(x, y) if row[f] >= cut]
            if low and high and gini(y) - gini(low) - gini(high) > best[0] + 1e-9:
                best = (gini(y) - gini(low) - gini(high), f, cut)
    _, f, cut = best
    if f is None:
        return lambda row, k=sum(y) * 2 >= len(y): k
    parts = [brute_tree([r for r in x if (r[f] < cut) == low], [v for r, v in zip(x, y) if (r[f] < cut) == low], depth - 1) for low in (True, False)]
    return lambda row: parts[0](row) if row[f] < cut else parts[1](row)


def brute_features(blocks):
    out = []
    for i, b in enumerate(blocks):
        near = [(blocks[j].words, blocks[j].link_words / blocks[j].words) if 0 <= j < len(blocks) else (0, 0) for j in (i, i - 1, i + 1)]
        marks = []
        for kind in KINDS:
            at = [j for j, (k, _) in enumerate(b.marks) if k == kind]
            above = [k for k, _ in b.marks[: at[-1]]] if at else []
            marks.append(0 if not at else 2 if "article" in above and kind not in ("article", "content") else 1)
        main = [o for o in blocks if any(k in ("article", "content") for k, _ in o.marks)]
        around = [element for kind, element in b.marks if kind not in ("article", "content")]
        inside = [sum(o.words for o in blocks if any(e == element for _, e in o.marks)) for element in around]
        rival = any(all(e != element for _, e in o.marks) for element in around for o in main)
        share = 0 if not inside else 1 if rival else 1 + min(inside) / sum(o.words for o in blocks)
        out.append([*near[0], *near[1], *near[2], b.heading, b.item, *marks, share, bool(main) and b not in main])
    return out


def test_features_and_tree_against_brute_force():
    xs, ys = table()
    x, y = np.vstack(xs).tolist(), np.concatenate(ys).tolist()
    brute = brute_tree(x, y)
    for page in (PAGE, *(p.replace("+", "+1").replace("-", "-2") for p in LABELLED)):
        blocks = labelled_blocks(page)[0]
        mine = features(blocks)
        assert np.allclose(mine, np.array(brute_features(blocks), float))
        assert list(TREE.predict(mine)) == [bool(brute(row)) for row in mine.tolist()]


def test_words_and_links_of_neighbours_decide_beside_marks():
    xs, ys = table()
    for names in (("words", "link_density"), ("words_before", "link_density_before", "words_after", "link_density_after"), (*KINDS, "share")):
        without = np.vstack(xs) * np.array([f not in names for f in FEATURES])
        assert (TREE.predict(without) != np.concatenate(ys).astype(bool)).sum() > 5, names
    # The same words and links with and without marks around them.
    long, plain = "<p>" + "word " * 60, "<ul><li><a>One</a><li><a>Two</a></ul>"
    assert main_text(plain + long * 2, TREE).count("\n") == 1 and "One" not in main_text(plain + long * 2, TREE)
    assert main_text(f"<article>{long}{plain}</article>", TREE).count("\n") == 2
    assert main_text(f"<div class=sidebar>{long}</div><p>" + "text " * 200, TREE).count("word") == 0
    assert main_text(f"<div class=sidebar>{long * 3}</div>", TREE).count("word") == 180


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_what_outweighs_the_article_goes():
    story, talk = words("s", 40), [words(f"c{k}x", 60) for k in range(6)]
    comments = "<section class=comments>" + "".join(f"<p>{t}</p>" for t in talk) + "</section>"
    for page in (
        f"<article><p>{story}</p>{comments}</article>", f"<article><p>{story}</p></article>{comments}", f"<main><p>{story}</p></main><aside><p>{words('a', 500)}</p></aside>",
        f"<div class=content><p>{story}</p></div><div class=sidebar><p>{words('a', 200)}</p><p>{words('b', 90)}</p></div>", f"<article><p>{story}</p></article><div class='cookie-banner'><p>{words('k', 300)}</p></div>",
        f"<div id=main><p>{story}</p><div class=ad><p>{words('a', 150)}</p></div></div>", f"<article><p>{story}</p><form><p>{words('f', 160)}</p></form></article>",
        f"<article><p>{story}</p><ul id=comments><li class=comment><article>{words('c', 180)}</article></li></ul></article>", f"<article><p>{story}</p></article><footer><p>{words('f', 400)}</p></footer>",
    ):
        assert main_text(page, TREE) == story, page


def test_comments_alone_are_no_main_text():
    assert main_text("<section class=comments><p>" + words("c", 50) + "</p><p>" + words("d", 70) + "</p></section>", TREE) == ""


def test_tables_are_kept_whole():
    cells = "<table><tr><th>Year</th><th>Name of it</th></tr><tr><td>2001</td><td>Old one</td></tr><tr><td>2002</td><td>New</td></tr></table>"
    kept = "Year\nName of it\n2001\nOld one\n2002\nNew"
    text = words("t", 45)
    assert main_text(f"<article><p>{text}</p>{cells}</article>", TREE) == f"{text}\n{kept}"
    assert main_text(f"<p>{text}</p>{cells}<p>{text}</p>", TREE) == f"{text}\n{kept}\n{text}"


def test_links():
    found = blocks_of("<p>see <a href=x>the page</a> now</p><ul><li><a>x y</a></ul>")
    assert [(b.words, b.link_words) for b in found] == [(4, 2), (2, 2)]


def test_rows(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t"), (2, "v", "", "t"), (3, "w", "<article><p>" + "long " * 200_000, "t")]
    out = {(r.page_id, r.url): r for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert out[(None, None)].text == "" and out[(2, "v")].n_chars == 0 and out[(3, "w")].n_chars == 999_999
    assert out[(1, "u")].text == main_text(PAGE, TREE) and out[(1, "u")].n_chars == len(out[(1, "u")].text)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on a small table of labelled URLs (a parameter) on the driver; its weights, one number per
hash bucket, go to the tasks.
"""

from __future__ import annotations

import itertools
import random
import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
RIDGE = 0.01
#: Step of the descent; rows have unit length and weights that sum to one, so steps up to 15 are stable.
RATE = 8.0
#: Hosts after which a worker's cache of host scores starts afresh.
CACHE_HOSTS = 200_000

# Words by which the seed table's hosts are labelled.
UNWANTED = """casino slots poker betting bets jackpot roulette win prize lottery pills pharmacy viagra cialis meds
cheap discount replica adult porn sex xxx escort dating cams nude spam farm seo backlinks traffic clicks
popup banner adserver ads track tracker doubleclick payday loans credit cash crypto giveaway free download crack
keygen warez torrent phishing malware""".split()
ORDINARY = """news daily times science nature history museum library school university college research health
hospital city council weather travel garden kitchen recipes books journal review music theatre cinema sports
football tennis forum wiki docs developer python software hardware photo gallery design art energy water
environment climate economy market finance bank insurance law court parliament election family parents children
animals birds ocean mountain river station railway airport bicycle motor engine bakery coffee wine restaurant
hotel holiday island village church community foundation society institute academy press radio television clothing
shipping printing training consulting engineering publishing housing fishing hiking cycling heating lighting catering
brewing gaming racing wedding painting planning sailing camping shoes furniture jewelry flowers toys pets dental
clinic salon studio legal accounting estate rental repair plumbing roofing solar electric mobile camera""".split()
_NAMES = ("{a}", "{a}-{b}", "{a}{b}", "{b}-{a}")
_BEFORE, _AFTER = ("", "www.", "blog.", "m."), (".example.com", ".example.net", ".example.org")
#: Paths that hold a word: {a} is the word that tells, {b} one that doesn't.
_TELLING = ("/{a}", "/{b}/{a}.html", "/{a}-{b}/{n}", "/shop/{b}-{a}/")
_PATHS = ("", "/", "/en/{n}", "/fr/{n}.html", "/de/{n}/", "/es/{n}")


def _drawn_words(count: int, seed: int = 7) -> list[str]:
    """Words of letters drawn at random, every other one of them of consonants and vowels in turn."""
    r = random.Random(seed)
    letters = (string.ascii_lowercase, string.ascii_lowercase), ("bcdfghjklmnprstvwz", "aeiou")
    drawn = ("".join(r.choice(letters[i % 2][k % 2]) for k in range(r.randint(4, 9))) for i in itertools.count())
    return list(itertools.islice((w for w in drawn if not any(u in w for u in UNWANTED)), count))


def seed_urls() -> list[tuple[str, int]]:
    """The labelled table that the filter uses unless another is given: (url, 1 if unwanted).

    A host with an unwanted word is unwanted, whatever stands beside that word: another, an ordinary or a drawn one;
    hosts of ordinary and drawn words aren't. A path with an unwanted word is unwanted on any host; the same host stands
    in the table with an ordinary word in the same path. Only words tell the labels apart: both take the same prefixes,
    domains, shapes and paths in turn.
    """
    out = []
    drawn = _drawn_words(2 * (len(UNWANTED) + len(ORDINARY)))
    kinds = [(UNWANTED, b, 1) for b in (UNWANTED, ORDINARY, drawn)] + [(ORDINARY, ORDINARY, 0), (ORDINARY, drawn, 0), (drawn, drawn, 0)]
    for words, beside, label in kinds:
        for i, word in enumerate(words):
            for j, name in enumerate(_NAMES):
                turn, other = i * len(_NAMES) + j, beside[(i * 7 + j * 3 + 1) % len(beside)]
                host = _BEFORE[(i + j) % 4] + name.format(a=word, b=other) + _AFTER[turn % 3]
                out.append((f"http://{host}{_PATHS[turn % len(_PATHS)].format(n=(i * 37 + j * 11) % 990)}", label))
    hosts = ORDINARY + drawn
    for i, word in enumerate(UNWANTED):
        for j, path in enumerate(_TELLING):
            turn = i * len(_TELLING) + j
            host = _BEFORE[turn % 4] + hosts[(turn * 5 + 3) % len(hosts)] + _AFTER[(i + j) % 3]
            beside = drawn[(turn * 3 + 1) % len(drawn)]
            for told, label in ((word, 1), (ORDINARY[(turn * 7 + 2) % len(ORDINARY)], 0)):
                out.append((f"http://{host}{path.format(a=told, b=beside, n=turn * 13 % 990)}", label))
    return sorted(set(out))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does. rules: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _buckets(text: str, kind: str) -> list[int]:
    marked = f"^{text}$"
    return [xxhash.xxh32_intdigest(f"{kind}{marked[i : i + n]}") % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1)]


def features(host: str, path: str) -> tuple[list[int], list[int]]:
    return _buckets(host, "h"), _buckets(path, "p")


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    path = rest[end:]
    return rest[:end], path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]


def train(labelled: Sequence[tuple[str, int]], ridge: float = RIDGE, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weights of the hash buckets and the bias, by gradient descent with momentum on the ridge objective."""
    found = [sorted(set(sum(features(*_split(url)), []))) for url, _ in labelled]
    used, where = np.unique(np.concatenate([np.array(f) for f in found]), return_inverse=True)
    sizes = np.array([len(f) for f in found])
    row = np.repeat(np.arange(len(found)), sizes)
    x = 1 / np.sqrt(sizes[row])
    y = np.array([label for _, label in labelled], float)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(len(used)), 0.0
    speed_w, speed_b = np.zeros(len(used)), 0.0
    for _ in range(steps):
        off = (1 / (1 + np.exp(-(np.bincount(row, x * w[where], len(found)) + b))) - y) * share
        speed_w = 0.9 * speed_w - RATE * (np.bincount(where, x * off[row], len(used)) + ridge * w / len(found))
        speed_b = 0.9 * speed_b - RATE * off.sum()
        w, b = w + speed_w, b + speed_b
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return weights, float(b)


def _score(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, int]] = {}

        def part(text: str, kind: str) -> tuple[float, int]:
            distinct = list(set(_buckets(text, kind)))
            return float(weights[distinct].sum()), len(distinct)

        for b in batches:
            out = []
            for host, path in zip(b["host"].to_pylist(), b["path"].to_pylist()):
                if host not in known:
                    if len(known) >= CACHE_HOSTS:
                        known.clear()
                    known[host] = part(host, "h")
                (s, n), (t, m) = known[host], part(path, "p")
                out.append(float(1 / (1 + np.exp(-((s + t) / max(n + m, 1) ** 0.5 + bias)))) if host else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "unwanted"])

    return run


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: Sequence[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and unwanted (the model's probability) of each row.

    A rule's verdict stands over the model's; of two that fit, the longer, and of equal length the one later in
    order of text. Null urls and urls without :// have an empty host and path, no rule and are allowed. Repeated
    rows and null page_ids are judged like any other; an empty table gives no rows; further columns are not read.
    """
    weights, bias = train(seed_urls() if labelled is None else labelled)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    scored = parts.mapInArrow(_score(weights, bias), "page_id long, host string, path string, unwanted double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    model = F.when(F.col("unwanted") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"), "unwanted")

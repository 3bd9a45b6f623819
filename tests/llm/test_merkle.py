import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tendergrid.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, path string, root int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(frame, row[:5])))


def tree(leaves):
    """Root, and each leaf's siblings as (left, right) level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            lo = i // 3 * 3
            paths[k].append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 3])))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted([s for s in by if s is not None], key=str.encode)
    names = [None] * (None in by) + names
    inner = {}
    for s in names:
        lined = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        inner[s] = (lined, *tree([leaf(r) for r in lined]))
    root, over = tree([inner[s][1] for s in names])
    out = []
    for s, up in zip(names, over):
        lined, sub, paths = inner[s]
        for r, p in zip(lined, paths):
            shown = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                shown = (*r[:4], r[4].replace("\n", ""))
            d = leaf(shown)
            for left, right in p + up:
                d = sha(left + d + right)
            out.append((r[0], leaf(r), sub, root, sha("".join(a + b for a, b in p + up)), d, d == root))
    return out


def made(sizes):
    r, n = random.Random(3), 0
    rows = []
    for s, k in sizes.items():
        for _ in range(k):
            n += 1
            rows.append((n, s, r.choice(["en", None, "ф"]), r.choice([None, 7, 123]), r.choice(["a\nb", "plain", "", None, "\n", "é𝒳\n"]), "p", 1))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [{"a": 1}, {None: 1, "b": 1}, {"a": 3}, {"a": 4, "é": 9, None: 10, "Z": 2, "": 3}, {"hot": 700, "b": 81, "c": 82, "d": 243, "e": 1} | {f"s{i}": 1 + i % 3 for i in range(90)}],
)
def test_against_brute_force(spark, sizes):
    rows = made(sizes)
    rows += [(None, rows[0][1], None, None, "no id\n", "p", 1)] * 2 + [rows[0]] * (len(rows) > 3) * 2
    got = merkle.manifest(spark.createDataFrame(rows, COLUMNS).repartition(4)).collect()
    key = lambda t: repr(t)
    assert sorted(map(tuple, got), key=key) == sorted(brute([r[:5] for r in rows]), key=key)


def test_paths_prove_membership(spark):
    rows = made({"a": 40, "b": 5})
    leaves = spark.createDataFrame(rows, COLUMNS).withColumn("leaf", merkle.leaf_digest([F.col(c) for c in merkle.FIELDS]))
    out = merkle.merkle_paths(leaves, "source", "doc_id", "leaf")
    assert set(out.columns) == {"rest", "path", "subroot", "root"}
    good = out.select((merkle.folded(F.col("rest.leaf"), F.col("path")) == F.col("root")).alias("ok"), (merkle.folded(F.sha2(F.lit("x"), 256), F.col("path")) == F.col("root")).alias("bad"), F.col("rest.path").alias("p"))
    assert {tuple(r) for r in good.collect()} == {(True, False, "p")}


def test_empty_and_long(spark):
    assert merkle.manifest(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [(2, "a", "en", 1, "line\n" * 300_000, "p", 1), (3, "a", "en", 1, "x", "p", 1)]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, COLUMNS)).collect())) == sorted(brute([r[:5] for r in rows]))

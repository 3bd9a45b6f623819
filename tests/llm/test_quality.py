import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tendergrid.llm import quality
from tendergrid.llm.quality import judge_quality, statistics, votes


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def made(n=150, seed=8):
    r = random.Random(seed)
    vocab = [f"wörd{i}" for i in range(500)] + ["#x", "A|B", "🙂"]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.choice([0, 2, 3, 49, 50, 120, 400]))]
        if r.random() < 0.3:
            words = words[:30] * 4
        rows.append((i, r.choice([" ", "\n", " \t", ".\n"]).join(words)))
    return rows + [(900, None), (901, ""), (902, " \n \n"), (903, "a\na\n a\nb"), (904, "a a a a"), (904, "a a a a"), (None, "x " * 100), (905, "p q r " * 20_000)]


def em(patterns):
    k = len(next(iter(patterns)))
    good, right, caught = 0.8, [0.9] * k, [0.4] * k
    clamp = lambda x, lo: min(0.99, max(lo, x))

    def post(v):
        said = sum(math.log(r / (1 - c)) if x > 0 else math.log((1 - r) / c) for x, r, c in zip(v, right, caught) if x)
        return 1 / (1 + math.exp(-(math.log(good / (1 - good)) + said)))

    for _ in range(quality.ROUNDS):
        q = {v: post(v) for v in patterns}
        total = sum(patterns.values())
        new_right, new_caught = [], []
        for j in range(k):
            said = [(v[j], n * q[v], n * (1 - q[v])) for v, n in patterns.items() if v[j]]
            new_right.append(clamp((sum(g for x, g, _ in said if x > 0) + 18) / (sum(g for _, g, _ in said) + 20), 0.5))
            new_caught.append(clamp((sum(b for x, _, b in said if x < 0) + 8) / (sum(b for _, _, b in said) + 20), 0.02))
        good = clamp((sum(n * q[v] for v, n in patterns.items()) + 16) / (total + 20), 0.01)
        right, caught = new_right, new_caught
    return {v: post(v) for v in patterns}


def test_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(d, t, 0, "q") for d, t in rows], "doc_id long, text string, votes int, quality string")
    out = judge_quality(df).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=str)
    counted = statistics(df).select("doc_id", *[c.alias(n) for n, c in votes().items()]).collect()
    patterns = Counter(tuple(r[1:]) for r in counted)
    want = em(patterns)
    by_doc = {r.doc_id: tuple(r[1:]) for r in counted}
    for r in out:
        assert abs(r.quality - want[by_doc[r.doc_id]]) < 1e-9
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = judge_quality(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert judge_quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = judge_quality(docs).filter("not base_failed").join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    assert out.filter("kept = (label = 1)").count() / out.count() > 0.97

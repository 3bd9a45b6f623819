import os
import random
import zlib
from collections import Counter

import pytest

from tendergrid.llm.language_id import gram_counts, held_out, learn_profiles, letters_table, predict_held_out, ranked

VOCAB = {"aa": ["lorem", "dolor", "sit", "éta"], "bb": ["zwischen", "über", "nicht", "ß"], "cc": ["日本", "語", "文字"]}


def made(n=240, seed=6):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(VOCAB))
        rows.append((i, " ".join(r.choice(VOCAB[lang]) + r.choice(["", ".", " 12"]) for _ in range(r.choice([3, 20, 200]))), lang))
    return rows + [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !?", "cc"), (903, "lorem", None), (None, "über nicht", "bb"), (904, "nicht", "bb"), (904, "nicht", "bb")]


def brute_grams(text):
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + " ".join(t.split(" ")).strip(" ") + " "
    while "  " in t:
        t = t.replace("  ", " ")
    if not t.strip():
        return Counter()
    out = Counter(c for c in t if c != " ") + Counter(t[i : i + 2] for i in range(len(t) - 1))
    return out + Counter(t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " ")


def code(gram):
    x = 0
    for c in gram:
        x = x << 21 | ord(c)
    return x


def test_gram_counts(monkeypatch):
    table = letters_table()
    for text in ("Été d'a été", "x", "  ", "1a2 b--c", "Über\nüber"):
        codes, counts = gram_counts(text, table)
        want = {code(g): n for g, n in brute_grams(text).items()}
        assert dict(zip(codes.tolist(), counts.tolist())) == want
    monkeypatch.setattr("tendergrid.llm.language_id.SLICE", 4)
    codes, counts = gram_counts("abc abc abc ", table)
    assert counts.sum() > 20 and (codes[1:] > codes[:-1]).all()
    assert len(ranked(*gram_counts("a b c d e", table), 3)) == 3


def test_predictions(spark):
    rows = made()
    df = spark.createDataFrame([(d, t, v, 0.5) for d, t, v in rows], "doc_id long, text string, lang string, score double")
    out = predict_held_out(df).collect()
    assert len(out) == len(rows)
    truth = {d: v for d, _, v in rows}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id in (900, 901, 902):
            assert r.lang_pred == "und" and r.score == 0
        elif r.doc_id not in (None, 903):
            assert r.lang_pred == truth[r.doc_id]


def test_profiles_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = learn_profiles(df.filter(~held_out(df.doc_id)))
    for lang in VOCAB:
        counts = Counter()
        for d, t, v in rows:
            if v == lang and d is not None and zlib.crc32(str(d).encode()) % 4 != 2:
                counts += Counter({code(g): n for g, n in brute_grams(t or "").items()})
        assert got[lang] == sorted(counts, key=lambda g: (-counts[g], g))[:400]


def test_nothing_learned_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in predict_held_out(df).collect()] == [("und", 0.0)]
    assert predict_held_out(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = predict_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = out.filter("lang = lang_pred").count() / out.count()
    assert right > 0.97

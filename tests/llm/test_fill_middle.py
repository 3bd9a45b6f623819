import hashlib
import random
import re

from pyspark.sql import functions as F

from tendergrid.llm import fill_middle as fm

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    assert pre + mid + suf == text
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def made():
    r = random.Random(1)
    words = ["a", "é", "𝒳yz", "<S", "P>", "<", " ", "　x", "word", "ก็"]
    text = lambda n: "".join(r.choice([" ", "\n", "  \t", "\r\n"]) + r.choice(words) for _ in range(n)) + r.choice(["", " ", "\n\n"])
    rows = [(i, text(r.choice([0, 1, 2, 3, 30, fm.STRETCH - 1, fm.STRETCH, fm.STRETCH + 1])), "x") for i in range(300)]
    rows += [(900 + i, t, "x") for i, t in enumerate([None, "", " ", "\n\n\n", "a <P> b", "<M>", "<S>x", "<", "x" * 5000])]
    rows += [(None, "null id one", "x"), (None, "null id two", "x"), (None, None, "x")]
    return rows + [(7, "other text of seven " * 9, "x")] + [(11, "copies of one row " * 40, "x")] * 5 + [(i, "very long " * 60_000 + str(i), "x") for i in (950, 951, 952, 953)]


def test_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string, rest string").repartition(5)
    got = fm.fill_middle(df).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    key = lambda x: repr(x)
    want = sorted([(d, t, *brute(d, t)) for d, t, _ in rows], key=key)
    assert sorted([(g.rest.doc_id, g.rest.text, g.n, g.form, g.prefix_chars, g.middle_chars, g.output) for g in got], key=key) == want
    assert all(g.back == (g.rest.text or "") for g in got)
    assert {g.form for g in got} == {"plain", "spm", "psm"}


def test_shares_are_arguments_and_empty(spark):
    df = spark.createDataFrame([(i, "some words here", i) for i in range(60)], "doc_id long, text string, n int")
    assert {g.form for g in fm.fill_middle(df, cut=100, suffix_first=0).collect()} == {"psm"}
    assert fm.fill_middle(df.limit(0)).count() == 0 and fm.fill_middle_digests(df.limit(0)).count() == 0


def test_digests(spark):
    df = spark.createDataFrame([(i, f"words of document {i} ", None, 4) for i in range(40)], "doc_id long, text string, lang string, k int")
    for r in fm.fill_middle_digests(df).collect():
        n, form, pre, mid, out = brute(r.doc_id, f"words of document {r.doc_id} ")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, pre, mid, hashlib.sha256(out.encode()).hexdigest())
        assert r.restored_sha256 == hashlib.sha256(f"words of document {r.doc_id} ".encode()).hexdigest()

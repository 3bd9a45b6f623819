import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tendergrid.llm.language_id import predict_held_out
from tendergrid.llm.near_dedup import keep_one_of_each


def made(seed=11, n=160):
    r = random.Random(seed)
    words = {"aa": ["lorem", "dolor", "sit", "éta", "amet"], "bb": ["zwischen", "über", "nicht", "während"]}
    rows = []
    for i in range(n):
        lang = r.choice(list(words))
        text = " ".join(r.choice(words[lang]) + r.choice(["", "x", "y", "zz"]) for _ in range(r.choice([4, 30, 200])))
        if i % 10 == 3:
            text += " token=abcdefgh12345"
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
    copies = [(1000 + i, rows[i][1] + " end", *rows[i][2:4], len(rows[i][1]) + 4) for i in range(0, 60, 2) if len(rows[i][1].split()) > 60]
    return rows + copies + [(2000, None, "aa", "src0", 0), (2001, "12 34 !", "bb", None, 7), (2002, "", None, "src1", 0), (2003, "lorem dolor sit amet eta", "aa", None, 24)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(made(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    told = {r.doc_id: r for r in predict_held_out(docs).collect()}

    one = stages["language_id"](spark, docs, table)
    assert one.columns == columns
    assert {r.doc_id for r in one.collect()} == {d for d, r in told.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE} == {r[0] for r in made()} - {2000, 2001, 2002}

    two = stages["near_dedup"](spark, one, table)
    assert two.columns == columns and not any(1000 <= r.doc_id < 1060 for r in two.collect())
    assert {r.doc_id for r in two.collect()} >= {r[0] for r in made() if r[0] < 160 and len(r[1].split()) > 100}

    three = stages["secrets"](spark, two, table)
    assert three.columns == columns and three.count() == two.count()
    texts = {r.doc_id: r.text for r in two.collect()}
    for r in three.collect():
        assert r.text == texts[r.doc_id].replace("token=abcdefgh12345", "[secret]")

    four = stages["mixing"](spark, three, table)
    assert four.columns == columns
    whole = {r.doc_id: r.text.split() for r in three.collect()}
    for r in four.collect():
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(whole[r.doc_id])
    taken, all_words = sum(len(r.text.split()) for r in four.collect()), sum(map(len, whole.values()))
    assert 1.4 * all_words <= taken <= 1.6 * all_words

    five = stages["packing"](spark, four, table)
    got = five.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in four.collect()}


#: Names that the operators give to columns of their own.
CLASHING = """score lang_pred row rest raw size begin block blocks quota start tie nth spans _spans _id _dk dk key id plain unnamed node n
members sketch sv slot v a b comp root centre found of changed redacted taken_text _p_doc_id _m_size _key lot shard target hash bucket""".split()


def test_clashing_columns(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet").filter("doc_id < 40 or doc_id >= 1000").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    docs = docs.withColumn("Key with space.and`dot", F.col("doc_id") * 2)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, table)
        if name == "packing":
            assert out.count() > 0
            continue
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING) and all(r[-1] == 2 * r.doc_id for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)


def test_run(spark, table):
    out = corpus_pipeline.run(spark, table)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_keep_one_of_each(spark):
    a = "one two three four five six seven eight nine ten " * 2
    rows = [(5, a), (3, a), (3, a), (9, ""), (9, ""), (8, None), (None, a), (None, "alone here"), (7, "different text of its own")]
    out = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, out.collect())) == sorted(f"Row(doc_id={d}, text={t!r})" for d, t in [(3, a), (9, ""), (9, ""), (8, None), (None, "alone here"), (7, "different text of its own")])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

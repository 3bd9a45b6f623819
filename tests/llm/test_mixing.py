import heapq
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tendergrid.llm.mixing import count_words, mix_sources, mixed_documents, sainte_lague, taken_texts


def made(n=400, seed=5):
    r = random.Random(seed)
    rows = [(i, r.choice([" ", "\n", " \t"]).join(["wö"] * r.choice([0, 1, 5, 40, 300])), r.choice(["a", "a", "a", "B", "é", None, "zz"]), "k") for i in range(n)]
    return rows + [(7001, None, "a", "k"), (7002, "", "B", "k"), (7003, "one two", "tiny", "k"), (7004, "w " * 30_000, "a", "k"), (7005, "s t", "zz", "k"), (7005, "s t", "zz", "k"), (None, "n o id", "zz", "k"), (7006, None, "void", "k")]


def targets(sizes, share=1.5, most=2):
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, goal = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = goal - sum(most * sizes[s] for s in full)
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def test_targets_and_taken(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    out = mix_sources(df).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = targets(sizes), {}
    assert len(out) == len(rows)
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 3)
    again = mix_sources(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, str(r.source), r.taken)
    assert sorted(map(key, again)) == sorted(map(key, out))
    texts = mixed_documents(df).collect()
    assert texts[0].asDict().keys() == {"doc_id", "text", "source", "shard"}
    by_doc, got = {}, {}
    for r in out:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.taken
    for r in texts:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {d: n for d, n in by_doc.items() if n}


def test_seats_are_those_of_the_highest_quotients(spark):
    r = random.Random(2)
    for house in (0, 1, 17, 500, 2000):
        parties = [(i, float(r.choice([0, 1, 3, 50, 900, r.random() * 100])), r.choice([0, 3, 100, 5000])) for i in range(25)]
        df = spark.createDataFrame(parties, "p int, votes double, most long").withColumn("house", F.lit(min(house, sum(p[2] for p in parties))).cast("long"))
        got = {x.p: x.seats for x in sainte_lague(df, [], [F.col("p")]).collect()}
        heap, want = [(-v, i, 0, m) for i, v, m in parties if m], dict.fromkeys(got, 0)
        heapq.heapify(heap)
        for _ in range(min(house, sum(p[2] for p in parties))):
            _, i, k, m = heapq.heappop(heap)
            want[i] += 1
            if k + 1 < m:
                heapq.heappush(heap, (-parties[i][1] / (2 * k + 3), i, k + 1, m))
        if all(want[i] < m or v == 0 or m >= v / (sum(p[1] for p in parties)) * house for i, v, m in parties):
            assert got == want


def test_count_words():
    texts = [b"", b"a", b" a b\n", b"\xc3\xa9 \xc2\xa0x", b"", b"x\x0by", b" "]
    a = pa.array(texts, pa.binary())
    assert count_words(a).tolist() == [len(t.split()) for t in texts]
    assert count_words(a.slice(2, 3)).tolist() == [2, 2, 0]


def test_taken_texts_covers_whole_and_part():
    assert taken_texts(b" a  b c ", 3, 0, 1, 3, 3, 0) == [b" a  b c "]
    assert taken_texts(b"a b\nc d", 4, 0, 2, 2, 1, 0) == [b"c d"]
    assert taken_texts(b"", 0, 5, 2, 2, 1, 0) == []


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(df).count() == 0 and mixed_documents(df).count() == 0

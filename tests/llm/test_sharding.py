import random
import zlib

from pyspark.sql import functions as F

from tendergrid.llm import sharding as sh

COLUMNS = "doc_id long, text string, shard string, h int"


def made(n=1500, hot=500, seed=2):
    r = random.Random(seed)
    rows = [(i, "é " * r.choice([0, 1, 5, 60, 400]) + str(i), "s", 1) for i in range(n)]
    rows += [(10_000 + i, "one text that a third of all rows share", "s", 1) for i in range(hot)]
    rows += [(20_000 + i // 5, f"group {i // 50} " * 9, "s", 1) for i in range(400)]
    return rows + [(None, None, "s", 1)] * 3 + [(30_000, "", "s", 1), (30_001, None, "s", 1), (30_002, "same row", "s", 1), (30_002, "same row", "s", 1)]


def collected(df, **how):
    return [(r.rest.doc_id, r.rest.text, r.size, r.text_crc32, r.shard, r.slot) for r in sh.shard_documents(df, **how).collect()]


def test_law_and_slots(spark):
    rows = made()
    df = spark.createDataFrame(rows, COLUMNS).repartition(7)
    got = collected(df)
    assert sorted(map(repr, [g[:2] for g in got])) == sorted(map(repr, [r[:2] for r in rows]))
    by = {}
    for _, text, size, crc, shard, slot in got:
        raw = (text or "").encode()
        assert size == len(raw) + 1 and crc == zlib.crc32(raw)
        by.setdefault(shard, []).append((slot, size))
    total = sum(g[2] for g in got)
    most = max(g[2] for g in got)
    assert set(by) == set(range(16))
    for held in by.values():
        assert sorted(s for s, _ in held) == list(range(len(held)))
        assert abs(sum(z for _, z in held) - total / 16) <= 2 * (total / 16 * sh.TOLERANCE + most)
    assert sorted(map(repr, collected(df.repartition(3)))) == sorted(map(repr, got))
    # Equal texts stay together unless their bytes are needed on both sides of a boundary.
    groups = {}
    for _, text, _, _, shard, _ in got:
        groups.setdefault(text, set()).add(shard)
    assert len([t for t, s in groups.items() if len(s) > 1 and t is not None]) <= 15
    assert len(groups["one text that a third of all rows share"]) < 16


def test_boundaries_are_the_nearest(spark):
    """Every splitter is within its tolerance, or no other boundary in key order lies nearer to its goal."""
    keyed = sh.keyed_rows(spark.createDataFrame(made(300, 100), COLUMNS)).select("h", "d", "i", F.col("size").alias("bytes"))
    lined = sorted(tuple(r) for r in keyed.collect())
    total = sum(r[3] for r in lined)
    below, at = {}, 0
    for h, d, i, size in lined:
        below[(h, d, i)] = at
        at += size
    goals = [("bytes", total / 16 * j, total / 16 * 0.01) for j in range(1, 16)]
    for (key, sums), (_, goal, tolerance) in zip(sh.find_splitters(keyed, goals, {"bytes": total}), goals):
        true = sum(size for h, d, i, size in lined if (h, d, i) < key)
        assert sums["bytes"] == true
        assert abs(true - goal) <= max(tolerance, min(abs(b - goal) for b in [*below.values(), total]))


def test_hot_group_is_split_in_many_parts(spark):
    rows = [(i, "hot", "s", 1) for i in range(3000)] + [(5000 + i, f"text {i}", "s", 1) for i in range(1000)]
    got = collected(spark.createDataFrame(rows, COLUMNS), shards=8)
    size = {}
    for g in got:
        size[g[4]] = size.get(g[4], 0) + g[2]
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 40


def test_one_long_text_few_rows_and_none(spark):
    rows = [(1, "x" * 1_000_000, "s", 1), (2, "a", "s", 1), (3, "b", "s", 1)]
    got = collected(spark.createDataFrame(rows, COLUMNS))
    assert len(got) == 3 and all(0 <= g[4] < 16 for g in got)
    by = {}
    for g in got:
        by.setdefault(g[4], []).append(g[5])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert collected(spark.createDataFrame([], COLUMNS)) == []
    assert collected(spark.createDataFrame([(5, None, "s", 1)] * 2, COLUMNS))[0][2] == 1
    assert sh.sharded(spark.createDataFrame(rows, COLUMNS)).select("law", "grown_shard").distinct().collect() == [("bytes", None)]


def test_no_python_in_the_plan(spark):
    plan = sh.sharded(spark.createDataFrame(made(50, 5), COLUMNS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapIn" not in plan


def test_written_shards(spark, tmp_path):
    rows = [(i, "w " * (i % 50), "s", 1) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    sh.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}

import datetime
import json

from pyspark.sql import functions as F

from tendergrid.functions.values import RAW_COLUMNS
from tendergrid.sources import io
from tendergrid.operators.merge import upsert
from tendergrid.streaming.contracts import upsert_stream, window_counts


def raw_rows(spark):
    row = dict.fromkeys(RAW_COLUMNS, "") | {"project_id": "P1", "project_name": 'งาน "ก",\nวางท่อ', "dept_name": "กรม  ก", "winner_name": "หจก. บริษัท ข", "winner_tin": "12xx", "contract_price_agree": "1,200.50", "contract_date": "20 พ.ย. 68", "announce_date": "1 พ.ย. 68", "project_location": "POINT(100.5 13.7)"}
    rows = [tuple(row.values()), tuple((row | {"project_id": "", "project_name": ""}).values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_COLUMNS))


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "raw")
    io.write_delimited(raw_rows(spark).coalesce(1), path)
    read = io.read_delimited(spark, path)
    mapping, confidence = io.guess_mapping([c for c in read.columns if c != "_corrupt"])
    assert confidence == 1 and mapping["winner_tin"] == "winner_tin"
    c = io.with_geo_quality(io.normalize(read, mapping))
    (r,) = c.collect()
    assert (float(r.contract_price_agree), r.contract_date, r.announce_gap_days, r.lat, r.winner_key, r.dept_key, r.tin_is_masked, r.geo_quality, r.work_group) == (1200.5, datetime.date(2025, 11, 20), 19, 13.7, "บริษัท ข", "กรม ก", True, "ok", "pipe")
    again = io.normalize(io.to_raw(c), {k: k for k in RAW_COLUMNS}).collect()[0]
    assert again.contract_date == r.contract_date and again.contract_price_agree == r.contract_price_agree and again.lat == r.lat


def test_sniffing():
    assert io.sniff_encoding("ก,ข".encode()) == "UTF-8" and io.sniff_encoding("กข".encode("cp874")) == "x-windows-874" and io.sniff_encoding(b"\xff\xfea\0") == "UTF-16LE"
    assert io.sniff_delimiter('a;b;c\n1;"x;y";3') == ";" and io.sniff_delimiter("a\tb\n1\t2") == "\t" and io.sniff_delimiter("") == ","
    assert io.guess_mapping(["รหัสโครงการ", "ราคากลาง (บาท)"])[0]["price_build"] == "ราคากลาง (บาท)"


def test_json_shapes(spark, tmp_path):
    rows = [{"project_id": "1", "n": 2}, {"project_id": "2"}]
    for i, shape in enumerate((rows, {"records": rows, "meta": {"a": 1}}, {"result": rows}, {"result": {"records": rows, "total": 2}}, {"data": rows})):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(shape))
        assert sorted(r.project_id for r in io.read_json_rows(spark, str(path)).collect()) == ["1", "2"]


def test_directors_and_json_sink(spark, tmp_path):
    lines = spark.createDataFrame([("1\tA\tx\trole",), ("1,A,x,role",), ("bad",), (" ",)], "value string")
    good, bad = io.parse_directors(lines)
    assert [(r.tax_id, r.person_name) for r in good.collect()] == [("1", "x")] and [r.line for r in bad.collect()] == ["bad"]
    io.write_json(spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double"), str(tmp_path / "out"))
    assert spark.read.schema("x double").json(str(tmp_path / "out")).filter("x is not null").count() == 1


def test_files_of_several_kinds(spark, tmp_path):
    names = "รหัสโครงการ,ชื่อโครงการ"
    for name, encoding, text in (("a.csv", "utf-8", f"{names}\n1,วางท่อ\n2,ถนน\n"), ("b.csv", "cp874", "id,name\n" + "1,plain\n" * 500 + "2,ถนน\n"), ("c.csv", "utf-16", f"{names}\n1,วางท่อ\n"), ("d.csv", "utf-8", 'id;name\n1;"two\nlines"\n2;x\n')):
        (tmp_path / name).write_bytes(text.encode(encoding))
    read = lambda name: [tuple(r)[:2] for r in io.read_contracts(spark, str(tmp_path / name)).collect()]
    assert read("a.csv") == [("1", "วางท่อ"), ("2", "ถนน")] and read("c.csv") == [("1", "วางท่อ")]
    assert read("b.csv")[-1] == ("2", "ถนน") and len(read("b.csv")) == 501 and read("d.csv") == [("1", "two\nlines"), ("2", "x")]
    (tmp_path / "e.json").write_text('[{"id": 1, "name": "x"}]')
    assert [r.name for r in io.read_contracts(spark, str(tmp_path / "e.json")).collect()] == ["x"]
    assert [r.id for r in io.rows_of_text(spark, '{"id": 7}').collect()] == ["7"]
    assert io.guess_mapping(["วันที่ประกาศ", "เขต", "คู่สัญญา"])[0]["announce_date"] == "วันที่ประกาศ"
    assert [io.deep_status({"schema": s, "data_generated_at": "t", "n_records": 2}, "t", n) for s, n in (("deep_pattern/2", 2), ("deep_pattern/2", 3), ("x", 2))] == ["ready", "stale", "unavailable"]
    for n in (3, 2):
        io.replace_table(spark.range(n), str(tmp_path / "table_of_ids"))
    assert spark.read.parquet(str(tmp_path / "table_of_ids")).count() == 2


def test_streams(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 5), "u"), (2, datetime.datetime(2024, 1, 1, 7), "u"), (3, datetime.datetime(2024, 3, 1), "v")], "id int, ts timestamp, user string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id int, ts timestamp, user string").parquet(src)
    q = window_counts(stream, "user", width="1 day").writeStream.format("memory").queryName("counts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select max(n) from counts where user = 'u'").first()[0] == 2
    rows = spark.readStream.schema("id int, ts timestamp, user string").parquet(src).select("id", "user", F.lit(0).alias("ord"))
    upsert_stream(rows, str(tmp_path / "table"), str(tmp_path / "check"), ("id",), "ord").awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "table" / "v=0")).count() == 3


def test_older_rows_of_later_batches_change_nothing(spark):
    base = spark.createDataFrame([(1, "new", 5), (2, "old", 1)], "id int, user string, ord int")
    late = spark.createDataFrame([(1, "stale", 3), (2, "", 4), (2, "newer", 3), (3, "added", 9)], "id int, user string, ord int")
    got = {(r.id, r.user, r.ord, r.merge_kind) for r in upsert(base, late, ("id",), "ord").collect()}
    assert got == {(1, "new", 5, "kept"), (2, "old", 4, "updated"), (3, "added", 9, "added")}
    again = {(r.id, r.user) for r in upsert(base.drop("ord"), spark.createDataFrame([(1, "b"), (1, "a")], "id int, user string"), ("id",)).collect()}
    assert again == {(1, "b"), (2, "old")}

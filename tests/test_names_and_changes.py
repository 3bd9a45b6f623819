"""Groups of names, places in names, shared places and what an upsert changes, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tendergrid.operators import analytics, merge, text
from tendergrid.operators.reports import number_key
from tendergrid.sources import io

GROUPS = (("road", "road"), ("light", "light"), ("bridge", "bridge"))


def test_overlaps_and_coverage(spark):
    names = spark.createDataFrame([("road with light",), ("light of road",), ("bridge road light",), ("bridge",), ("well",), ("",), (None,)], "project_name string")
    assert [tuple(r) for r in text.group_overlaps(names, GROUPS).collect()] == [("light", "road", 3), ("bridge", "light", 1), ("bridge", "road", 1)]
    assert [tuple(r) for r in text.group_overlaps(names, GROUPS, top=1).collect()] == [("light", "road", 3)]
    assert tuple(text.group_coverage(names, GROUPS).first()) == (7, 4, round(4 / 7, 6), round(3 / 7, 6))
    assert tuple(text.group_coverage(names.limit(0), GROUPS).first()) == (0, 0, 0.0, 0.0) and text.group_overlaps(names.limit(0), GROUPS).count() == 0


def test_places_in_names(spark):
    at = "ถนน หมู่ที่ ๓ ตำบลบางรัก"
    rows = [("a", at, 5.0), ("a", at + " อำเภอเมือง", None), ("a", "ทาง หมู่ที่ ๓ ต.บางรัก", 2.0), ("b", at, 1.0), ("a", "หมู่ที่ 3", 1.0), ("a", None, 1.0)]
    t = spark.createDataFrame(rows + [("c", "หมู่ที่ 9 ต.หนอง", None)] * 3, "dept_key string, project_name string, contract_price_agree double")
    assert {tuple(r) for r in text.repeated_places(t).collect()} == {("a", "หมู่ ๓ ต.บางรัก", 3, 7.0), ("c", "หมู่ 9 ต.หนอง", 3, 0.0)}


def test_other_provinces(spark):
    rows = [(1, "ถนน จังหวัดนครพนม", "นครปฐม"), (2, "ถนน จังหวัด ตาก", "ตาก"), (3, "ถนน จังหวัดน่าน", "ตาก"), (4, "ถนน", "ตาก"), (5, "จังหวัดน่าน", None), (6, "จังหวัดน", "ตาก"), (7, None, "ตาก"), (8, "จังหวัดเลย", "ตาก"), (9, "จังหวัดประจวบ", "ประจวบคีรีขันธ์")]
    got = text.province_mismatch(spark.createDataFrame(rows, "i int, project_name string, province string"))
    # The first four letters of the province tell: the fourth differs in row 1, none of them in row 9. Row 8 begins with a vowel.
    assert {(r.i, r.said_province) for r in got.collect()} == {(1, "นครพนม"), (3, "น่าน")}


def test_shared_places(spark):
    rows = [("P1", f"n{i % 4}", "ab"[i % 2], "x") for i in range(6)] + [(" P1 ", "n0", None, "y")] + [("P2", f"n{i % 2}", "a", "x") for i in range(9)]
    rows += [("P3", n, None, None) for n in ("u", "v", None)] + [(p, f"n{i}", "a", "x") for p in ("-", "", None) for i in range(5)]
    t = spark.createDataFrame(rows, "project_location string, project_name string, dept_key string, province string")
    got = [(r.place, r.n, r.names, r.depts, r.dept, r.province) for r in analytics.shared_places(t).orderBy("place").collect()]
    assert got == [("P1", 7, 4, 3, "a", "x"), ("P3", 3, 3, 1, None, None)]
    assert [r.place for r in analytics.shared_places(t, top=1).collect()] == ["P1"]


def test_changes(spark):
    shape = "id int, no string, price double, name string"
    base = spark.createDataFrame([(i, None if i % 2 else "1", 10.0 * i, "x") for i in range(20)] + [(99, "1", None, None)], shape)
    new = spark.createDataFrame([(i, None if i % 2 else "1", 1.0 if i < 9 else 10.0 * i, "" if i < 15 else "y") for i in range(18)] + [(99, "1", 3.0, None), (50, "1", 1.0, "z")], shape)
    key = ("id", "no")
    changed = merge.changes(base, merge.upsert(base, new, key), key)
    want = {(i, "price", str(10.0 * i), "1.0") for i in range(9)} | {(i, "name", "x", "y") for i in range(15, 18)} | {(99, "price", None, "3.0")}
    assert {(r.id, r.field, r.before, r.after) for r in changed.collect()} == want
    shown = merge.change_examples(changed, key).collect()
    assert {(r.field, r.n) for r in shown} == {("price", 10), ("name", 3)} and sorted(r.id for r in shown if r.field == "price") == [0, 1, 2, 3, 4]


def test_number_keys_and_metadata(spark):
    got = spark.createDataFrame([("7",), ("7.0",), ("7.5",), (None,)], "x string").select(number_key(F.col("x")).alias("k"))
    assert [r.k for r in got.collect()] == ["7", "7", "7.5", None]
    with pytest.raises(ValueError):
        io.payload({"x": float("nan")})
    assert json.loads(io.payload({"b": 1, "a": "ก"})) == {"a": "ก", "b": 1}

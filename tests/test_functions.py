"""Parsers, rules at their thresholds, and the rule language on small rows."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendergrid.functions import parse
from tendergrid.functions.stats import beta_tail, chi_squared_tail
from tendergrid.operators import dsl, merge, rules

D = datetime.date


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_money(spark):
    values = ["3,498,760,900.00", "-", "", "nan", None, "n/a", "฿1,200 บาท", "๑,๒๐๐", "abc", "฿", " 5.5 "]
    got = column(spark, values, parse.money)
    assert [None if x is None else float(x) for x in got] == [3498760900.0, None, None, None, None, None, 1200.0, 1200.0, None, None, 5.5]


def test_dates(spark):
    values = ["20 พ.ย. 68", "2568-11-20", "2025-11-20", "20 พฤศจิกายน 2568", "20/11/2568", "20/11/68", "31 ก.พ. 68", "-", "x y z", "20 พ.ย. 2025", "๒๐ พ.ย. ๖๘", None]
    got = column(spark, values, lambda c: parse.thai_date(c)[0])
    day = D(2025, 11, 20)
    assert got == [day] * 6 + [None, None, None, D(1482, 11, 20), day, None]
    assert column(spark, values[:3] + ["-"], lambda c: parse.thai_date(c)[1]) == ["thai", "iso", "iso", "empty"]
    assert column(spark, [day, None], parse.to_thai_date, "date") == ["20 พ.ย. 68", ""]


def test_wkt(spark):
    values = ["POINT(100.5 13.7)", "LINESTRING(100.5 13.7, 100.7 13.9)", "POINT(13.7 100.5)", "POINT EMPTY", "-", None]
    got = [(x.lat, x.lon, x.geom_type) for x in column(spark, values, parse.wkt_point)]
    assert got == [(13.7, 100.5, "POINT"), (13.8, 100.6, "LINESTRING"), (None, None, "POINT"), (None, None, "POINT"), (None, None, None), (None, None, None)]


def test_names_and_groups(spark):
    values = ["ห้างหุ้นส่วนจำกัด ห้างหุ้นส่วนจำกัด สิทธิยนต์", "บริษัท  ก  จำกัด", "กลุ่ม ก (สัญญากิจการค้าร่วม)", None, " หจก. บริษัท ข"]
    assert column(spark, values, parse.canonical_name) == ["ห้างหุ้นส่วนจำกัด สิทธิยนต์", "บริษัท ก จำกัด", "กลุ่ม ก", "", "บริษัท ข"]
    assert column(spark, values, parse.is_joint_venture) == [False, False, True, False, False]
    assert column(spark, ["130990115xxxx", "1234", None], parse.is_masked) == [True, False, False]
    assert column(spark, ["จ้างก่อสร้างถนนคอนกรีต", "ซื้อมาตรวัดน้ำ", "๕ อัตรา", "อะไร", None], parse.first_group) == ["road", "meter", "staff", "other", "other"]
    assert column(spark, ["หมู่ที่ ๓ ตำบลบางรัก", "หมู่ที่ 3", None], parse.place_of) == ["หมู่ ๓ ต.บางรัก", None, None]
    assert column(spark, ["ถนน กว้าง 5 เมตร ยาว 1.5 กม.", "พื้นที่ ๑,๐๐๐ ตารางเมตร", "x"], parse.road_area) == [7500.0, 1000.0, None]


@pytest.mark.parametrize("budget,days", [(500_000, None), (500_001, 5), (5_000_001, 10), (10_000_001, 12), (50_000_001, 20)])
def test_notice(spark, budget, days):
    assert column(spark, [budget], parse.min_notice_days, "long") == [days]


def test_bands(spark):
    assert column(spark, [0.0, 0.0001, 19.99, 20.0, 40.0, 60.0, 100.0], parse.band, "double") == ["none", "low", "low", "medium", "high", "critical", "critical"]


def test_beta_and_chi_squared():
    assert np.allclose(beta_tail(np.array([0.3, 0.5, 0.9]), np.array([1.0, 2.0, 9.0]), np.array([1.0, 2.0, 1.0])), [0.7, 0.5, 1 - 0.9**9], atol=1e-8)
    assert abs(chi_squared_tail(15.507, 8) - 0.05) < 1e-4 and abs(chi_squared_tail(3.841, 1) - 0.05) < 1e-4 and abs(chi_squared_tail(7.815, 3) - 0.05) < 1e-4


SCHEMA = "project_id string, contract_no string, dept_key string, winner_key string, winner_tin string, tin_is_masked boolean, contract_price_agree decimal(18,2), price_build decimal(18,2), project_money decimal(18,2), sum_price_agree decimal(18,2), contract_date date, duration_days int, announce_gap_days int, purchase_method_name string, project_type_name string, province string, lat double, lon double, geo_quality string"


def contract(**more):
    row = {"project_id": "p", "contract_no": "1", "dept_key": "d", "winner_key": "w", "winner_tin": "t", "tin_is_masked": False, "contract_price_agree": 90, "price_build": 100, "project_money": 100, "sum_price_agree": 90, "contract_date": D(2024, 1, 3), "duration_days": 5,
           "announce_gap_days": 30, "purchase_method_name": "x", "project_type_name": "k", "province": "v", "lat": None, "lon": None, "geo_quality": "none"} | more
    from decimal import Decimal

    return tuple(Decimal(row[n.split()[0]]) if "decimal" in n and row[n.split()[0]] is not None else row[n.split()[0]] for n in SCHEMA.split(", "))


def hits(spark, rows, only, check=False):
    out = rules.evaluate(spark.createDataFrame(rows, SCHEMA), rules.configured(only=only), check=check).collect()
    return sorted((r.project_id, r.contract_no, tuple(h.rule_id for h in r.rule_hits), r.risk_score, r.risk_band) for r in out)


def test_rules_at_their_thresholds(spark):
    rows = [
        contract(project_id="a", contract_price_agree=70, dept_key="d1"), contract(project_id="b", contract_price_agree=71, dept_key="d2"), contract(project_id="c", contract_price_agree=100, dept_key="d3"),
        contract(project_id="e", contract_price_agree=None, dept_key="d4"), contract(project_id="f", project_money=0, dept_key="d5"), contract(project_id="g", contract_price_agree=101, dept_key="d6"),
    ]
    got = {r[0]: r[2:4] for r in hits(spark, rows, ("R1", "R2", "R4", "R13"))}
    assert got == {"a": (("R1", "R2"), 15.0), "b": ((), 0.0), "c": (("R13",), 15.0), "e": ((), 0.0), "f": ((), 0.0), "g": (("R4", "R13"), 45.0)}
    weekend = [contract(project_id="sat", contract_date=D(2024, 1, 6)), contract(project_id="sun", contract_date=D(2024, 1, 7)), contract(project_id="mon", contract_date=D(2024, 1, 8)), contract(project_id="none", contract_date=None)]
    assert {r[0] for r in hits(spark, weekend, ("R19",)) if r[2]} == {"sat", "sun"}


def test_splits_and_unscored(spark):
    rows = [contract(project_id="a", contract_price_agree=250_000), contract(project_id="b", contract_price_agree=200_000), contract(project_id="c", contract_price_agree=10, duration_days=-1, contract_date=D(2024, 2, 1))]
    got = {r[0]: r[2:4] for r in hits(spark, rows, ("R10", "R23", "R11"))}
    assert got == {"a": (("R10", "R23"), 25.0), "b": (("R10", "R23"), 25.0), "c": (("R11",), 0.0)}
    assert not any(r[2] for r in hits(spark, rows, ("R10",), check=True))


def test_what_if_equals_evaluation_without_the_rule(spark):
    rows = [contract(project_id=str(i % 7), contract_no=str(i), contract_price_agree=60 + i * 3, dept_key=f"d{i % 3}", contract_date=D(2024, 1, 1 + i % 20)) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    some = ("R1", "R2", "R3", "R4", "R13", "R15", "R19", "R23")
    whole = rules.what_if(rules.evaluate(df, rules.configured(only=some), check=False), exclude=["R3", "R1"])
    again = rules.evaluate(df, rules.configured(only=[r for r in some if r not in ("R3", "R1")]), check=False)
    key = lambda r: (r.project_id, r.contract_no)
    assert {key(r): r.what_if_score for r in whole.collect()} == {key(r): r.risk_score for r in again.collect()}


def test_settings(tmp_path):
    path = str(tmp_path / "settings.json")
    rules.save_settings(path, {"R1": {"enabled": False}, "R2": {"weight": 5, "thresholds": {"pct": 0.5}}})
    got = rules.configured(rules.load_settings(path))
    assert "R1" not in got and got["R2"].weight == 5 and got["R2"].thresholds == {"pct": 0.5}
    with pytest.raises(ValueError):
        rules.configured({"R2": {"thresholds": {"nothing": 1}}})


def test_rule_language(spark):
    df = spark.createDataFrame([(1, None, None, "Abc"), (2, 5.0, "x", None), (3, 7.0, "y", "zabcz")], "i int, risk_score double, province string, project_name string")
    find = lambda *c, match="all": [r.i for r in df.filter(dsl.compile_rule({"name": "n", "match": match, "conditions": [dict(zip(("field", "op", "value"), x)) for x in c]})).orderBy("i").collect()]
    assert find(("risk_score", "!=", 5)) == [3] and find(("province", "!=", "x")) == [1, 3] and find(("province", "not_in", ["x", "y"])) == [1]
    assert find(("project_name", "contains", "ABC")) == [1, 3] and find(("risk_score", "between", [7, 5])) == [2, 3]
    assert find(("risk_score", ">", 6), ("province", "==", "x"), match="any") == [2, 3]
    for bad in ({"name": "", "conditions": [{}]}, {"name": "n", "conditions": []}, {"name": "n", "conditions": [{"field": "risk_score", "op": "in", "value": [1]}]}):
        with pytest.raises(ValueError):
            dsl.validate(bad)


def test_upsert(spark):
    base = spark.createDataFrame([("a", "1", "t", "old", 1), ("b", "1", "t", "keep", 2)], "project_id string, contract_no string, winner_tin string, name string, price int")
    new = spark.createDataFrame([("a", "1", "t", "", 9, 1), ("c", "1", "t", "first", 3, 1), ("c", "1", "t", "last", 4, 2)], "project_id string, contract_no string, winner_tin string, name string, price int, ord int")
    merged = merge.upsert(base.withColumn("ord", F.lit(0)), new, order="ord")
    assert sorted((r.project_id, r.name, r.price, r.merge_kind) for r in merged.collect()) == [("a", "old", 9, "updated"), ("b", "keep", 2, "kept"), ("c", "last", 4, "added")]

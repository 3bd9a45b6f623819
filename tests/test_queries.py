"""Every query with SQL against DuckDB over the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tendergrid.plans.oracles import ORACLES
from tendergrid.plans.queries import QUERIES
from tendergrid.plans.reports import REPORT_SQL, REPORTS

ALL, SQL = QUERIES | REPORTS, ORACLES | REPORT_SQL
SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def comparable(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "isoformat"):
            return str(x)[:10]
        if isinstance(x, (bool, str)) or type(x).__name__ == "bool":
            return str(x)
        return float(x)

    return sorted((tuple(cell(x) for x in row) for row in df.itertuples(index=False)), key=str)


def test_names():
    assert set(SQL) <= set(ALL) and not set(QUERIES) & set(REPORTS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, want = comparable(ALL[name](spark, SF).toPandas()), comparable(duck.sql(SQL[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x == y if not isinstance(x, float) else y is not None and abs(x - y) <= 1e-9 * max(1, abs(x)), (a, b)


@pytest.mark.parametrize("name", ["rule_summary_all", "kmeans_contractors", "isolation_forest", "discount_hurdle", "direct_purchase_confidence", "graph_pagerank", "association_rules", "mined_traits", "agency_discount_z", "hurdle_quality", "forest_stability", "component_errors", "anomaly_factors", "mined_terms", "digit_tests", "sibling_rounding", "unit_cost_kinds"])
def test_models_run(spark, name):
    out = ALL[name](spark, SF).toPandas()
    assert len(out)
    if name == "isolation_forest":
        assert len(out) == 60_000 and out.ml_score.between(0, 1).all()
    if name == "anomaly_factors":
        assert out.groupby(["project_id", "contract_no", "winner_key", "contract_date", "price"]).ngroups == 400 and not (out.delta < 0.002).any()
    if name == "unit_cost_kinds":
        assert len(out) == 6 and out.n.sum() == 60_000 and (out.effect == 1).sum() == 1 and out.elasticity.between(-1.02, -0.98).all()
    if name == "component_errors":
        assert len(out) == 60_000 and (out.pca_error >= 0).all()
    if name == "graph_pagerank":
        assert abs(out["rank"].sum() - 1) < 1e-6

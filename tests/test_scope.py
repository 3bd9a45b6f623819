"""The order and scope of files in parts, against plain Python over the same lines."""

import random

import pytest

from tendergrid.sources.scope import file_scope, row_order

SCHEMA = "project_id string, project_name string, sum_price_agree double, contract_price_agree double, project_money double, price_build double"


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def saved(folder, files):
    for name, rows in files.items():
        (folder / name).write_text("".join(",".join("" if x is None else str(x) for x in r) + "\n" for r in rows))
    return str(folder)


def rows(n, project=lambda i: f"p{i}", price=lambda i: None, name="ถนน", contract=lambda i: i):
    return [(project(i), name, price(i), contract(i), None, 5) for i in range(n)]


def up(values):
    return sum(a is not None and b is not None and b > a for a, b in zip(values, values[1:]))


def test_order_over_splits(spark, tmp_path, small_splits):
    r = random.Random(1)
    files = {"b.csv": rows(400, price=lambda i: r.choice([None, r.randint(1, 99)]), contract=lambda i: 900 - i), "a.csv": rows(700, price=lambda i: r.randint(1, 9), contract=lambda i: 2000 - i), "c.csv": []}
    df = spark.read.schema(SCHEMA).csv(saved(tmp_path, files))
    assert df.rdd.getNumPartitions() > 5
    got = {x.field: x for x in row_order(df).collect()}
    lines = files["a.csv"] + files["b.csv"]
    for j, f in ((2, "sum_price_agree"), (3, "contract_price_agree"), (4, "project_money"), (5, "price_build")):
        values = [x[j] for x in lines]
        known = [v for v in values if v is not None]
        assert (got[f].n, got[f].n_missing, got[f].n_up, got[f].least) == (1100, values.count(None), up(values), min(known, default=None))
        assert got[f].falling == (None not in values and up(values) == 0)
    assert got["contract_price_agree"].falling and got["price_build"].falling


def test_border_alone_breaks_the_order(spark, tmp_path, small_splits):
    df = spark.read.schema(SCHEMA).csv(saved(tmp_path, {"a.csv": rows(50, contract=lambda i: 99 - i), "b.csv": rows(50, contract=lambda i: 99 - i)}))
    got = {x.field: x for x in row_order(df, ["contract_price_agree"]).collect()}
    assert got["contract_price_agree"].n_up == 1 and not got["contract_price_agree"].falling


def test_scope(spark, tmp_path, small_splits):
    def told(name, lines):
        (tmp_path / name).mkdir()
        return file_scope(spark.read.schema(SCHEMA).csv(saved(tmp_path / name, {"x.csv": lines}))).first()

    capped = told("capped", rows(1000, price=lambda i: 5000 - i))
    assert tuple(capped) == ("sum_price_agree", 4001.0, 1000, 1000, True, "ถนน", 1.0)
    cut = told("cut", rows(1200, project=lambda i: f"p{i // 2}", price=lambda i: 5000 - i, name="น้ำ ประปา"))
    assert cut.n_projects == 600 and not cut.looks_capped and cut.name_keyword == "ประปา" and cut.cutoff_value == 3801
    mixed = told("mixed", [(f"p{i}", "ถนน" if i else None, i % 7, i % 5, 3 + i % 2, None) for i in range(1000)])
    assert mixed.sort_key is None and mixed.cutoff_value is None and not mixed.looks_capped and mixed.keyword_share == 0.999
    assert tuple(told("none", [])) == (None, None, 0, 0, False, None, None)

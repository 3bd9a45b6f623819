"""Steps that must not grow with the square of the rows, nor move or sort all of them."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendergrid.functions import stats
from tendergrid.operators import analytics, autoencoder, context, digits, fields, graph, models, patterns, reports, rules, text
from tendergrid.operators import unit_costs as uc
from tendergrid.plans.contracts import viewed
from tendergrid.tables import written


def test_quantiles_sort_only_values_near_them(spark, monkeypatch):
    r = np.random.default_rng(3)
    values = np.concatenate([np.exp(r.normal(9, 2, 20_000)), -np.exp(r.normal(0, 3, 5000)), np.zeros(500)])
    sorted_rows, real = [], stats.running
    monkeypatch.setattr(stats, "running", lambda counts, *a: sorted_rows.append(counts.count()) or real(counts, *a))
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    got = stats.quantiles(df, "x", [], {"a": 0.01, "m": 0.5, "z": 0.999}).first()
    assert np.allclose([got.a, got.m, got.z], np.quantile(values, [0.01, 0.5, 0.999]), rtol=1e-12) and got.n == len(values)
    assert sorted_rows[0] < len(values) / 20


def test_quantiles_of_the_least_and_the_greatest(spark):
    xs = [float("inf"), float("-inf"), 5e-324, -5e-324, 0.0, 1e308, -1e308]
    got = stats.quantiles(spark.createDataFrame([(x,) for x in xs], "x double"), "x", [], {f"q{i}": i / 6 for i in (1, 2, 3, 4, 5)}).first()
    assert [got[f"q{i}"] for i in (1, 2, 3, 4, 5)] == sorted(xs)[1:6]


def test_scores_keep_only_what_is_asked_for(spark):
    rows = [(i, 1, f"a{i % 3}", f"w{i % 5}", 100_000 + 10 * i, 120_000, 500_000, 30) for i in range(60)]
    c = spark.createDataFrame(rows, "project_id int, contract_no int, dept_key string, winner_key string, contract_price_agree int, price_build int, project_money int, duration_days int")
    few, whole = models.anomaly_scores(c, keep=["project_id"]), models.anomaly_scores(c)
    assert few.columns == ["project_id", "ml_score"] and sorted(few.collect()) == sorted(whole.select("project_id", "ml_score").collect())


def test_repeated_names_meet_once(spark, monkeypatch):
    r = random.Random(4)
    words = [f"word{i}" for i in range(12)]
    names = [" ".join(r.sample(words, 5)) for _ in range(30)] + ["alpha beta gamma delta omega", "omega alpha beta gamma delta"]
    rows = [(f"a{i % 2}", i // 2, i, f"2024-01-{1 + i % 28:02d}" if i % 9 else f"2024-03-{1 + i % 28:02d}", names[i % len(names)]) for i in range(900)]
    df = spark.createDataFrame(rows, "dept_key string, project_id int, contract_no int, d string, project_name string").withColumn("contract_date", F.to_date("d"))
    kept, real = [], text.written
    monkeypatch.setattr(text, "written", lambda d: kept.append(real(d)) or kept[-1])
    got = {tuple(x) for x in text.near_repeats(df, ["dept_key"]).collect()}
    day = {i: (0 if d[5:7] == "01" else 60) + int(d[8:]) for _, _, i, d, _ in rows}
    want = set()
    for x, y in itertools.combinations(rows, 2):
        a, b = set(x[4].split()), set(y[4].split())
        if x[0] == y[0] and x[1] != y[1] and abs(day[x[2]] - day[y[2]]) <= 30 and 100 * len(a & b) >= 80 * len(a | b):
            want.add((x[0], x[1], x[2], y[1], y[2], round(len(a & b) / len(a | b), 6)))
    assert got == want and len(want) > 900
    # What is compared are lists of words, not contracts.
    assert kept[1].count() <= 2 * len({frozenset(n.split()) for n in names})


def test_unit_costs_take_no_median_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(uc.F, "median", None)
    works = spark.createDataFrame([(float(100 + i * 7 % 40), float(1 + i % 9), f"k{i % 2}") for i in range(80)], "p double, s double, k string")
    out, kinds = uc.unit_costs(works, "p", "s", "k")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and kinds.count() == 2


def test_sums_of_a_fit_are_those_of_its_design(spark):
    r = np.random.default_rng(5)
    y, x, z, k = r.normal(size=50), r.normal(size=50), r.normal(size=50), r.integers(-1, 3, 50)
    rows = spark.createDataFrame([(float(a), float(b), float(c), int(d)) for a, b, c, d in zip(y, x, z, k)], "y double, x0 double, x1 double, kind int").repartition(3)
    design = np.column_stack([np.ones(50), x, z, *[k == j for j in range(3)]])
    tried = r.normal(size=(2, 6))
    for b, got in zip(tried, uc._totals(rows, ["x0", "x1"], ["a", "b", "c"], tried, 0.5, 0.25)):
        e = y - design @ b
        s = np.sqrt(e * e + 0.0625)
        want = [[np.sqrt(e * e + 0.25).sum()], design.T @ (e / s), (design.T @ (design * (0.0625 / s**3)[:, None])).ravel(), (design.T @ (design / s[:, None])).ravel()]
        assert np.allclose(got, np.concatenate(want))


COLUMNS = "project_id long, contract_no long, dept_key string, winner_key string, winner_tin string, tin_is_masked boolean, d string, contract_price_agree long, price_build long, project_money long, sum_price_agree long"


def _contracts(spark, n: int = 400):
    r = random.Random(8)
    some = lambda x: None if r.random() < 0.05 else x
    rows = [(some(i // 3), i % 3, some(f"a{r.randrange(3)}"), some(f"w{r.randrange(4)}"), f"t{r.randrange(3)}", False, some(f"2024-01-{1 + r.randrange(9):02d}"), some(r.randrange(1, 400_000)), 300_000, 500_000, 400_000) for i in range(n)]
    return spark.createDataFrame(rows, COLUMNS).withColumn("contract_date", F.to_date("d"))


def test_contexts_of_rows_are_those_of_joins(spark):
    c = _contracts(spark)
    groups, projects = context.same_day_groups(c), context.projects(c)
    key = ["project_id", "contract_no", "dept_key", "winner_key", "contract_date", "contract_price_agree"]
    want = c.join(groups, ["dept_key", "winner_key", "contract_date"], "left").join(projects, "project_id", "left")
    got = context.with_same_day_groups(context.joined_projects(context.with_projects(c)))
    columns = [*key, "g_n", "g_priced", "g_total", "g_max", "g_projects", "p_n", "p_sum", "p_missing", "p_total"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_rules_deal_rows_once_and_narrow(spark):
    c = written(context.with_projects(_contracts(spark)))
    chosen = rules.configured({"R3": {"thresholds": {"min": 2}}}, only=["R1", "R2", "R3", "R4", "R10", "R15", "R23"])
    sets = rules.hit_sets(rules.evaluate(c, chosen, check=False))
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    above = plan[: plan.index("Join")]
    assert "price_build#" not in above and "project_money#" not in above
    plain = rules.hit_sets(rules.evaluate(_contracts(spark), chosen, check=False))
    assert sorted(sets.select("hit_mask", "n").collect()) == sorted(plain.select("hit_mask", "n").collect())


def test_what_if_from_the_mask_is_that_of_the_hits(spark):
    chosen = rules.configured(only=["R1", "R2", "R3", "R4", "R10", "R15", "R23"])
    e = rules.evaluate(_contracts(spark), chosen, check=False)
    args = {"exclude": ["R3"], "weights": {"R15": 40.0, "R2": 2.0}}
    score = lambda df: sorted(map(str, df.select("project_id", "contract_no", "contract_price_agree", "what_if_score").collect()))
    narrow = rules.what_if(e, **args, rules=chosen)
    assert score(narrow) == score(rules.what_if(e, **args))
    assert "rule_hits" not in narrow.select("what_if_score")._jdf.queryExecution().optimizedPlan().toString()


def test_contracts_are_read_once_for_links_pairs_and_profiles(spark):
    c = _contracts(spark).withColumns({"purchase_method_name": F.lit("m")})
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert reads(graph.degrees(graph.edges(c))) == 0 and reads(patterns.pair_patterns(c)) == 0 and reads(analytics.agency_profiles(c)) == 0


def test_rows_meet_medians_without_a_task_a_group(spark):
    df = written(spark.createDataFrame([(float(i * 37 % 101), f"g{i % 3}") for i in range(600)], "x double, g string"))
    z = stats.robust_z(df, "x", ["g"], "z")
    plan = z._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_frequent_sets_are_those_of_the_rows(spark):
    r = random.Random(2)
    rows = [tuple(sorted(x for x in "abcdef" if r.random() < 0.45)) for _ in range(300)]
    lists = spark.createDataFrame([(list(x),) for x in rows], "items array<string>").groupBy("items").agg(F.count("*").alias("n"))
    want = {}
    for x in rows:
        for k in (1, 2, 3):
            for s in itertools.combinations(x, k):
                want[s] = want.get(s, 0) + 1
    got = {tuple(x["items"]): x.freq for x in models.frequent_sets(lists, 40, 3).collect()}
    assert got == {s: n for s, n in want.items() if n >= 40} and max(map(len, got)) > 1


def test_fields_join_no_row_by_agency(spark):
    c = _contracts(spark)
    out = fields.with_fields(c, c, ["pair_share_of_agency", "pair_n_contracts"])
    # Of the two joins, the outer one alone takes contracts: by agency and winner.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and plan.count("Join Inner") == 1


def test_contracts_of_one_row_group_are_dealt(spark):
    src = "/root/testdata/sf0.1"
    if not os.path.isdir(src):
        pytest.skip("no test tables")
    view = viewed(spark, src).select("project_id", F.input_file_name().alias("file"))
    rows = view.groupBy("file").count().toPandas()["count"]
    assert len(rows) > 1 and rows.max() < 2 * rows.mean()
    assert view.distinct().groupBy("project_id").count().filter("count > 1").isEmpty()


def test_branches_are_drawn_for_by_all_tasks(spark):
    rows = [("org", f"s{b}", f"m{i % 3}", 20_000.0 + (i + b) % 4) for b in range(200) for i in range(20)]
    c = spark.createDataFrame(rows, "dept_key string, dept_sub_name string, purchase_method_name string, contract_price_agree double")
    out = digits.sibling_test(c, draws=50).withColumn("task", F.spark_partition_id()).toPandas()
    assert len(out) == 200 and out.task.nunique() == spark.sparkContext.defaultParallelism


def test_draws_one_by_one_are_those_of_the_law():
    class Counted(np.random.Generator):
        calls = 0

        def multinomial(self, *args):
            self.calls += 1
            return super().multinomial(*args)

    rng = Counted(np.random.PCG64(4))
    n, share = np.array([3, 48, 300, 1, 48, 40]), np.array([[0.1, 0.2, 0.3, 0.4], [0, 0, 1, 0], [0.25, 0.5, 0.25, 0], [0, 1, 0, 0], [0.01, 0, 0.09, 0.9], [0.5, 0.5, 0, 0]])
    got = digits._drawn(rng, n, share, 40_000).T
    # One cell alone has so many contracts that they are drawn at once.
    assert rng.calls == 1 and (got.sum(1) == n.sum()).all() and (got >= 0).all()
    assert np.allclose(got.mean(0), n @ share, atol=0.15)
    assert np.allclose(np.cov(got.T), sum(k * (np.diag(p) - np.outer(p, p)) for k, p in zip(n, share)), atol=2)


def test_median_of_all_is_taken_only_where_a_group_has_none(spark, monkeypatch):
    asked, real = [], reports.quantiles
    monkeypatch.setattr(reports, "quantiles", lambda df, x, by, shares: asked.append(by) or real(df, x, by, shares))
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 8.0), (None, None)], "g string, x double")
    assert sorted(r.y for r in reports.imputed(df, "x", ["g"], "y").collect()) == [1.0, 2.0, 3.0, 8.0, 8.0] and asked == [["g"]]
    lone = df.union(spark.createDataFrame([("b", None)], "g string, x double"))
    assert sorted(r.y for r in reports.imputed(lone, "x", ["g"], "y").collect()) == [1.0, 2.0, 3.0, 3.0, 8.0, 8.0] and asked[1:] == [["g"], []]


def test_a_pass_learns_in_the_arrays_it_has(spark):
    r = np.random.default_rng(6)
    x, order = r.normal(size=(1, 200, 12)), [r.permutation(200)] * 3
    values = np.array([autoencoder.flat(autoencoder.start(12, s)) for s in range(3)])
    learned = {}
    for kind in (np.float64, autoencoder.LEARNT):
        side = autoencoder.Adam(values.astype(kind), 12)
        layers = [id(a) for a in side.layers]
        side.learn(x.astype(kind), np.zeros(3, np.intp), order)
        assert layers == [id(a) for a in side.layers] and {a.dtype for a in (side.values, side.first, side.second, *side.layers)} == {np.dtype(kind)}
        learned[kind] = side.values
    assert np.allclose(learned[np.float64], learned[autoencoder.LEARNT], atol=1e-5)

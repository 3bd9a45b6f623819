"""A round's passes hand blocks of rows to Python, and rows meet small tables where they lie."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from tendergrid.operators import autoencoder, models, reports


def features(spark, n=600, parts=2):
    r = np.random.default_rng(3)
    data = [(i % 5, i % 7 == 0, *map(float, row)) for i, row in enumerate(r.normal(size=(n, 4)))]
    return spark.createDataFrame(data, "fold int, held boolean, " + ", ".join(f"x{i} double" for i in range(4))).repartition(parts)


def test_blocks_hold_every_row_as_it_is(spark, monkeypatch):
    columns, rows = [f"x{i}" for i in range(4)], features(spark)
    got = [t for t in autoencoder._tables(autoencoder.blocks(rows, columns).toPandas(), columns)]
    assert 1 < len(got) <= 2 + math.ceil(600 / autoencoder.BLOCK)
    back = sorted((int(f), bool(h), *map(float, v)) for x, fold, held in got for v, f, h in zip(x, fold, held))
    assert back == sorted(tuple(r) for r in rows.collect())
    empty = autoencoder.blocks(rows.filter("fold > 9"), columns)
    assert empty.count() == 0 and list(autoencoder._tables(empty.toPandas(), columns)) == []


def test_a_round_over_blocks_is_the_round_over_their_rows(spark):
    columns, rows = [f"x{i}" for i in range(4)], features(spark).toPandas()
    nets = {(k, s): autoencoder.flat(autoencoder.start(4, 10 * k + s)) for k in range(5) for s in range(2)}
    run = autoencoder._round(nets, {k: (np.zeros(4), np.ones(4)) for k in range(5)}, columns, 2)
    block = pd.DataFrame({"features": [rows[columns].to_numpy().tobytes()], "folds": [rows.fold.to_numpy(np.uint8).tobytes()], "helds": [rows.held.to_numpy(np.uint8).tobytes()]})
    (one,), (other,) = list(run(iter([rows]))), list(run(iter([block])))
    pd.testing.assert_frame_equal(one, other)
    # Errors of held rows, added up by another path.
    for (k, s), values in nets.items():
        z = rows[rows.held & (rows.fold != k)][columns].to_numpy()
        want = ((autoencoder.forward(autoencoder.unflat(values, 4), z)[-1] - z) ** 2).mean(1).sum()
        assert np.isclose(one[(one.out == k) & (one.seed == s) & (one.i == -2)].v.item(), want, rtol=1e-5)


def contracts(spark, n=4000):
    kinds = ["cast(id % 3 as string) project_type_name", "cast(id % 2 as string) purchase_method_name"]
    return spark.range(n).selectExpr("id project_id", "cast(1 as int) contract_no", "cast(id % 7 as string) dept_key", "cast(id % 11 as string) winner_key", "100000 + id % 997 contract_price_agree", "120000L price_build", "500000L project_money", "cast(id % 40 as int) duration_days", *kinds)


def test_small_tables_are_known_to_be_small_before_the_run(spark):
    """Rows aren't shuffled to meet groups' sizes or the chances of discounts."""
    c = contracts(spark)
    for found in (reports.scoring_groups(c, "project_type_name"), models.hurdle(models.with_groups(c))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

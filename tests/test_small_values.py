"""What large tables are written and read as: small values, few bytes a row."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tendergrid.functions import stats
from tendergrid.operators import autoencoder, models, text
from tendergrid.tables import written


def features(spark, n=700):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 4)) * [1, 5, 0.02, 1] + [0, 9, 14, 3]
    return spark.createDataFrame([(i % 5, i % 7 == 0, *map(float, row)) for i, row in enumerate(x)], "fold int, held boolean, " + ", ".join(f"x{i} double" for i in range(4))).repartition(2)


def test_rounds_read_rows_of_a_few_bytes(spark, monkeypatch):
    rows, columns, kept, real = features(spark), [f"x{i}" for i in range(4)], [], autoencoder.written
    monkeypatch.setattr(autoencoder, "written", lambda df, *a, **k: kept.append(real(df, *a, **k)) or kept[-1])
    best, _ = autoencoder.fit(rows, columns, seeds=1, rounds=2)
    (table,) = kept
    size = sum(F.octet_length(c) for c in table.columns)
    assert len(best) == 5 and table.count() == 700 and table.agg(F.max(size)).first()[0] <= 8 * 4 + 2


def test_a_round_over_packed_rows_is_the_round_over_rows(spark):
    rows, columns = features(spark), [f"x{i}" for i in range(4)]
    scales = autoencoder.fold_scales(rows, columns)
    nets = {(k, s): autoencoder.flat(autoencoder.start(4, 10 * k + s)) for k in range(5) for s in range(2)}
    whole = rows.toPandas()
    table = autoencoder.packed(spark.createDataFrame(whole).coalesce(1), columns, scales[0]).toArrow()
    (batch,) = table.combine_chunks().to_batches()
    x, fold, held = map(np.concatenate, zip(*autoencoder.unpacked(batch, 4)))
    mean, spread = scales[0]
    assert np.allclose(x * spread + mean, whole[columns], atol=1e-5) and (fold == whole.fold).all() and (held == whole.held).all()
    assert [len(t[0]) for b in (batch.slice(3, 5), batch.slice(0, 0)) for t in autoencoder.unpacked(b, 4)] == [5]
    near = {k: ((m - mean) / spread, s / spread) for k, (m, s) in scales.items()}
    (one,), (other,) = autoencoder._round(nets, scales, columns, 2)(iter([whole])), autoencoder._packed_round(nets, near, 4, 2)(iter([batch]))
    assert isinstance(other, pa.RecordBatch)
    other = other.to_pandas()
    assert one[["out", "seed", "i"]].astype(int).equals(other[["out", "seed", "i"]].astype(int)) and np.allclose(one.v, other.v, rtol=1e-4, atol=1e-2)


def contracts(spark, n=4000):
    kinds = ["cast(id % 3 as string) project_type_name", "cast(id % 2 as string) purchase_method_name"]
    return spark.range(n).selectExpr("id project_id", "cast(1 as int) contract_no", "if(id % 8 = 0, null, cast(id % 7 as string)) dept_key", "if(id % 10 = 0, null, cast(id % 11 as string)) winner_key", "100000 + id % 997 contract_price_agree", "120000L price_build", "500000L project_money", "cast(id % 40 as int) duration_days", *kinds)


def test_values_of_a_table_are_not_written_again_for_medians(spark, monkeypatch):
    df = written(contracts(spark).select("project_type_name", F.col("contract_price_agree").alias("x"), F.col("duration_days").alias("y")))
    want = sorted(map(tuple, stats.robust_z_of(df, ["x", "y"], ["project_type_name"]).collect()), key=repr)
    kept, real = [], stats.written
    monkeypatch.setattr(stats, "written", lambda d, *a, **k: kept.append(real(d, *a, **k)) or kept[-1])
    got = stats.robust_z_of(df, ["x", "y"], ["project_type_name"], of=df)
    assert sorted(map(tuple, got.collect()), key=repr) == want and max(t.count() for t in kept) < 4000


def test_rows_are_shuffled_once_for_their_features(spark):
    c = written(contracts(spark))
    featured, _ = models.anomaly_features(c, ["project_id", "dept_key", "winner_key", "contract_price_agree"])
    # Contracts meet pairs, and agencies; what pairs tell of winners comes with them.
    assert featured._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2
    rows = featured.toPandas()
    value = lambda by: rows.groupby(by, dropna=False).contract_price_agree.transform("sum")
    assert np.allclose(rows.pair_value_share, value(["dept_key", "winner_key"]) / value(["winner_key"]))
    assert np.allclose(rows.log_winner_agencies, np.log1p(rows.groupby("winner_key", dropna=False).dept_key.transform("nunique")))
    assert np.allclose(rows.log_agency_size, np.log1p(rows.groupby("dept_key", dropna=False).project_id.transform("count")))


def test_pairs_found_once_are_not_made_distinct(spark):
    r = random.Random(7)
    names = ["alpha beta gamma delta omega", "omega alpha beta gamma delta", "alpha beta gamma delta omega kappa", "kappa alpha beta gamma delta", "sigma kappa tau"]
    # Contracts of one to four rows, some alike, on days that lie close together or far apart.
    rows = [(f"a{i % 2}", i % 40, i % 3, 19_000 + r.choice([0, 0, 1, 29, 30, 31, 60, 200]), r.choice(names)) for i in range(260)]
    rows += [(None, 1, 1, 19_000, names[0]), ("a0", None, 1, 19_000, names[0]), ("a0", 2, None, 19_000, names[0]), ("a0", 2, None, 19_000, names[0])]
    df = spark.createDataFrame(rows, "dept_key string, project_id int, contract_no int, d int, project_name string").withColumn("contract_date", F.date_from_unix_date("d"))
    got = text.near_repeats(df, ["dept_key"])
    want = set()
    for x, y in itertools.permutations(rows, 2):
        a, b = set(x[4].split()), set(y[4].split())
        if x[0] and x[0] == y[0] and None not in (x[1], y[1]) and x[1] < y[1] and abs(x[3] - y[3]) <= 30 and 100 * len(a & b) >= 80 * len(a | b):
            want.add((x[0], x[1], x[2], y[1], y[2], round(len(a & b) / len(a | b), 6)))
    found = list(map(tuple, got.collect()))
    assert set(found) == want and len(found) == len(want) > 500
    # The table of pairs is two parts; of those found once none is aggregated, nor shuffled.
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
    lone = text.near_repeats(df.dropDuplicates(["project_id", "contract_no"]).withColumn("contract_no", F.monotonically_increasing_id()), ["dept_key"])
    assert lone.count() == lone.distinct().count() > 50

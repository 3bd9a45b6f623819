import numpy as np

from tendergrid.operators import autoencoder, models


def rows_of_a_plane(spark, n=3000):
    r = np.random.default_rng(1)
    t = r.normal(size=(n, 2))
    x = np.hstack([t, t @ r.normal(size=(2, 4))])
    data = [(i % 5, i % 7 == 0, *map(float, row)) for i, row in enumerate(x)]
    return x, spark.createDataFrame(data, "fold int, held boolean, " + ", ".join(f"x{i} double" for i in range(6))).repartition(3)


def test_each_network_trains_on_all_rows_of_the_other_folds(spark):
    x, rows = rows_of_a_plane(spark)
    columns = [f"x{i}" for i in range(6)]
    models_ = {(out, seed): autoencoder.flat(autoencoder.start(6, seed)) for out in range(5) for seed in range(2)}
    scales = {out: (x.mean(0), x.std(0)) for out in range(5)}
    got = rows.mapInPandas(autoencoder._round(models_, scales, columns, 0), "out int, seed int, i int, v double").filter("i in (-1, -3)").groupBy("out", "seed", "i").sum("v").collect()
    for r in got:
        want = [i for i in range(3000) if i % 5 != r["out"] and (i % 7 == 0) == (r["i"] == -3)]
        assert r["sum(v)"] == len(want)
    assert len(got) == 20


def test_training_stops_and_tells_odd_ones(spark):
    x, rows = rows_of_a_plane(spark)
    columns = [f"x{i}" for i in range(6)]
    best, scales = autoencoder.fit(rows, columns, seeds=1, rounds=15)
    assert set(best) == {(out, 0) for out in range(5)}
    error = lambda k, v: ((autoencoder.forward(autoencoder.unflat(best[k], 6), autoencoder.scaled(v, scales[k[0]]))[-1] - autoencoder.scaled(v, scales[k[0]])) ** 2).mean()
    for k in best:
        unseen = x[k[0] :: 5]
        assert error(k, unseen) < 0.2 and error(k, np.random.default_rng(2).permuted(unseen, axis=0)) > 3 * error(k, unseen)


def test_contracts_without_agency_winner_or_province_are_scored(spark):
    keys = [("a", "w", "p"), (None, "w", "p"), ("a", None, "p"), ("a", "w", None), (None, None, None), (None, None, None)]
    rows = [(i, 1, *keys[i % 6], 100_000 + 10 * i, 120_000, 500_000, 30) for i in range(60)] + [(99, 1, "a", "w", "p", None, 120_000, 500_000, 30)]
    c = spark.createDataFrame(rows, "project_id int, contract_no int, dept_key string, winner_key string, province string, contract_price_agree int, price_build int, project_money int, duration_days int")
    assert sorted(r.project_id for r in models.anomaly_scores(c).collect() if 0 <= r.ml_score <= 1) == list(range(60))
    featured, _ = models.anomaly_features(c)
    assert {round(r.log_pair_count, 9) for r in featured.filter("dept_key is null and winner_key is null").collect()} == {round(float(np.log1p(20)), 9)}


def learned_alone(values, z, order):
    """One network's pass over z in an order, written out."""
    params = [p.copy() for p in autoencoder.unflat(values, z.shape[1])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t, at in enumerate(range(0, len(order), autoencoder.BATCH), 1):
        part = z[order[at : at + autoencoder.BATCH]]
        layers = autoencoder.forward(params, part)
        delta = 2 * (layers[-1] - part) / len(part)
        for i in (6, 4, 2, 0):
            grads = (layers[i // 2].T @ delta, delta.sum(0))
            delta = (delta @ params[i].T) * (1 - layers[i // 2] ** 2)
            for j, g in zip((i, i + 1), grads):
                first[j], second[j] = 0.9 * first[j] + 0.1 * g, 0.999 * second[j] + 0.001 * g * g
                params[j] = params[j] - autoencoder.RATE * (first[j] / (1 - 0.9**t)) / (np.sqrt(second[j] / (1 - 0.999**t)) + 1e-8)
    return autoencoder.flat(params)


def test_networks_side_by_side_learn_what_they_would_alone():
    r = np.random.default_rng(5)
    x = r.normal(size=(2, 300, 6))
    values = np.array([autoencoder.flat(autoencoder.start(6, s)) for s in range(4)])
    of, orders = np.array([0, 1, 1, 0]), [r.permutation(300)[:n] for n in (300, 64, 0, 129)]
    side = autoencoder.Adam(values, 6)
    side.learn(x, of, orders)
    for v, i, o, got in zip(values, of, orders, side.values):
        assert np.allclose(got, learned_alone(v, x[i], o), atol=1e-12)

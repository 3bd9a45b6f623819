"""Models against plain Python: forest, discounts, explanations, components, terms and digits."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tendergrid.functions.parse import all_groups  # noqa: F401
from tendergrid.functions.stats import chi_squared_tail
from tendergrid.operators import autoencoder, digits, models, text

NAMES = [f"f{i}" for i in range(5)]


def walked(forest, row):
    total = 0.0
    for feature, cut, below, path in forest.trees:
        at = 0
        while feature[at] >= 0:
            at = below[at][int(row[feature[at]] > cut[at])]
        total += path[at]
    return 2.0 ** (-total / len(forest.trees) / forest.expected(forest.size))


def test_forest_walks_its_trees():
    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(400, 4)), 1)
    forest = models.Forest(x, 20, 64, 3)
    assert np.allclose(forest.score(x[:60]), [walked(forest, row) for row in x[:60]])
    assert forest.score(np.array([[9.0, 9, 9, 9]]))[0] > np.quantile(forest.score(x), 0.99)


def grouped(spark, n=600):
    r = random.Random(2)
    rows = [(i, f"g{i % 4}", i % 5, *[round(r.gauss(0, 1 + j), 2) for j in range(5)]) for i in range(n)]
    rows[7] = (7, "g3", 2, 40.0, 0.0, 0.0, 0.0, -30.0)
    return rows, spark.createDataFrame(rows, f"id int, {models.GROUP} string, fold int, " + ", ".join(f"{c} double" for c in NAMES)).repartition(3)


def explained(rows, score, least, top):
    """Plain occlusion: a row's features one after another at the median of its group."""
    first = sorted(rows, key=lambda r: (-score(r, r[3:]), r[0]))[:top]
    out = {}
    for r in first:
        found = []
        for i, name in enumerate(NAMES):
            peer = float(np.median([q[3 + i] for q in rows if q[1] == r[1]]))
            tried = list(r[3:])
            tried[i] = peer
            delta = score(r, r[3:]) - score(r, tried)
            if delta > least:
                found.append((-delta, name, r[3 + i], peer))
        out[r[0]] = [(n, -d, v, p) for d, n, v, p in sorted(found)[:3]]
    return out


def test_explanations_are_plain_occlusion(spark):
    rows, df = grouped(spark)
    forest = models.Forest(np.array([r[3:] for r in rows]), 30, 128, 0)
    scored = models.scored(df, NAMES, {"ml_score": forest.score}, ["id", models.GROUP, *NAMES])
    got = models.explain(scored, df, NAMES, "ml_score", ["id"], 0.002, lambda v: models.scored(v, NAMES, {"_new": forest.score}, ["id", "ml_score", "_at", "_own", "_peer"]), top=40).collect()
    want = explained(rows, lambda r, x: walked(forest, x), 0.002, 40)
    assert {r.id for r in got} == set(want) and 7 in want
    for r in got:
        assert [f.feature for f in r.factors] == [f[0] for f in want[r.id]]
        assert np.allclose([[f.delta, f.value, f.peer] for f in r.factors] or [[]], [f[1:] for f in want[r.id]] or [[]])


def test_deep_explanations_use_the_networks_of_the_rows_fold(spark):
    rows, df = grouped(spark)
    nets = {(k, s): autoencoder.flat(autoencoder.start(5, 10 * k + s)) for k in range(5) for s in range(2)}
    scales = autoencoder.fold_scales(df, NAMES)
    for k, (mean, spread) in scales.items():
        rest = np.array([r[3:] for r in rows if r[2] != k])
        assert np.allclose(mean, rest.mean(0)) and np.allclose(spread, rest.std(0))
    error = autoencoder.networks_error(nets, scales, 5, 2)
    scored = autoencoder._errors(df, NAMES, ["id", models.GROUP, "fold", *NAMES], "deep_error", error)
    keep = ["id", "deep_error", "_at", "_own", "_peer"]
    got = models.explain(scored, df, NAMES, "deep_error", ["id"], 0.005, lambda v: autoencoder._errors(v, NAMES, keep, "_new", error), top=25).collect()
    want = explained(rows, lambda r, x: float(error(r[2], np.array([x]))[0]), 0.005, 25)
    assert {r.id for r in got} == set(want)
    for r in got:
        assert [f.feature for f in r.factors] == [f[0] for f in want[r.id]]


def test_components_are_those_of_numpy(spark):
    rows, df = grouped(spark)
    scales = autoencoder.fold_scales(df, NAMES)
    found = autoencoder.principal_components(df, NAMES, scales)
    for k in range(5):
        z = autoencoder.scaled(np.array([r[3:] for r in rows if r[2] != k]), scales[k])
        own = autoencoder.scaled(np.array([r[3:] for r in rows if r[2] == k]), scales[k])
        mean = z.mean(0)
        _, _, v = np.linalg.svd(z - mean, full_matrices=False)
        want = (((own - mean) @ v[:3].T @ v[:3] + mean - own) ** 2).mean(1)
        m, p = found[k]
        assert np.allclose((((own - m) @ p.T @ p + m - own) ** 2).mean(1), want, atol=1e-6)


def test_discounts_on_cells_are_those_on_rows(spark):
    r = random.Random(8)
    rows = []
    for i in range(900):
        build = 10 ** r.uniform(4, 8)
        price = build if r.random() < 0.3 + 0.3 * (i % 3 == 0) else build * r.choice([0.99, 0.9, 0.7, 1.2, 1.7, 0.0])
        rows.append((i, 1, r.choice(["กรมน้ำ", "เทศบาลตำบลก", "x", None]), "w", ["m0", "m0", "m1", "m2", None][i % 5], f"t{i % 7 % 3}", price, build))
    rows += [(2000 + i, 1, "x", "w", "rare", "t0", 80.0, 100.0) for i in range(29)]
    c = spark.createDataFrame(rows, "project_id int, contract_no int, dept_key string, winner_key string, purchase_method_name string, project_type_name string, contract_price_agree double, price_build double")
    used, cells = models._discount_cells(c)
    fit = models.Discounts(cells.collect())
    data = [x.asDict() for x in used.collect()]
    assert len(data) == sum(0 < q[6] <= 1.5 * q[7] for q in rows) == fit.n
    assert not any("rare" in n for n in fit.names)
    as_cell = [dict(method=d["_method"], group=d["_group"], agency=d["_agency"], size=d["_size"]) for d in data]
    x = fit.design(as_cell)
    zero = np.array([abs(d["contract_price_agree"] / d["price_build"] - 1) < 1e-6 for d in data], float)
    assert np.allclose(fit.zero, models._irls(x, np.ones(len(x)), zero), atol=1e-6)
    depth = np.array([d["_depth"] is not None for d in data])
    y = np.array([d["_depth"] or 0.0 for d in data])[depth]
    beta = np.linalg.solve(x[depth].T @ x[depth] + np.eye(x.shape[1]), x[depth].T @ y)
    residual = y - x[depth] @ beta
    assert np.allclose(fit.depth, beta, atol=1e-8) and fit.sigma == pytest.approx(residual.std()) and fit.r2 == pytest.approx(1 - residual.var() / y.var())
    fold, held = np.array([d["_fold"] for d in data]), np.zeros(len(data))
    for k in range(5):
        held[fold == k] = 1 / (1 + np.exp(-(x[fold == k] @ models._irls(x[fold != k], np.ones((fold != k).sum()), zero[fold != k]))))
    pos, neg = held[zero == 1], held[zero == 0]
    assert fit.auc_cv == pytest.approx(((pos[:, None] > neg + 1e-12).sum() + (abs(pos[:, None] - neg) <= 1e-12).sum() / 2) / (len(pos) * len(neg)), abs=1e-3)
    told = {q.project_id: q for q in models.hurdle(c).collect()}
    p = 1 / (1 + np.exp(-(x @ fit.zero)))
    assert all(abs(told[d["project_id"]].p_zero - v) < 1e-6 for d, v in zip(data, p))


def mined(names, known, least=3, shortest=4, longest=32, top=25):
    """Terms as the source finds them, over all names."""
    import re

    from tendergrid.functions import values as v

    u = lambda p: p.replace("(?U)", "").replace("(?s)", "")
    bare = lambda s: re.sub(r"\s+", " ", re.sub(u(v.NAME_LEAD), "", re.sub("(?s)" + u(v.NAME_TAIL), "", s or ""), count=1)).strip()
    new, old = [bare(n) for n in names if not known(n)], [bare(n) for n in names if known(n)]
    counts = Counter()
    for s in new:
        counts.update({tk[:n] for raw in re.split(u(v.PHRASE_ENDS), s) for tk in [re.sub("[0-9๐-๙]+", " ", raw).strip()] for n in range(shortest, min(len(tk), longest) + 1)})
    pool = {}
    for seed, c in list(counts.items()):
        if len(seed) != shortest or c < least:
            continue
        at = seed
        while len(at) < longest:
            nexts = sorted((-n, g) for g, n in counts.items() if len(g) == len(at) + 1 and g.startswith(at) and n >= 0.7 * c)
            if not nexts:
                break
            at = nexts[0][1]
        term = re.sub(r"^[\s\-–—.,]+|[\s\-–—.,]+$", "", re.sub(v.NO_WORD_START, "", re.sub(v.NO_WORD_END, "", at)))
        if len(term) >= shortest:
            pool[term] = max(pool.get(term, 0), counts[at])
    scored = []
    for t, n in pool.items():
        leak = sum(t in s for s in old)
        hit, rate = n / len(new), leak / max(1, len(old))
        if hit >= 3 * rate:
            scored.append((-(hit - rate), -n, -len(t), t, leak))
    kept = []
    for _, n, _, t, leak in sorted(scored):
        places = [m.start() for s in new for m in re.finditer(f"(?={re.escape(t)})", s)]
        at = [(s, m.start()) for s in new for m in re.finditer(f"(?={re.escape(t)})", s)]
        after = sum(bool(re.search(r"[0-9๐-๙][\s.,]*$", s[max(0, i - 4) : i])) for s, i in at) / max(1, len(places))
        if len(kept) < top and after < 0.6 and not any(t in k or k in t for k, *_ in kept):
            kept.append((t, -n, leak))
    return kept


def test_terms_against_brute_force(spark):
    r = random.Random(5)
    things = ["เครื่องสูบน้ำแรงดันสูง", "มาตรวัดน้ำ", "คอมพิวเตอร์โน้ตบุ๊ก", "กล้องวงจรปิด", "ซอฟต์แวร์ระบบ", "รถบรรทุก"]
    lead, tail = ["ประกวดราคาซื้อ", "จ้างเหมา", "ซื้อ", ""], [" โดยวิธีเฉพาะเจาะจง", " ด้วยวิธีคัดเลือก x", ""]
    dry = [t for t in things if t != "มาตรวัดน้ำ"]
    names = [f"{r.choice(lead)}{r.choice(dry)} จำนวน {r.randrange(1, 40)} {r.choice(['เครื่อง', 'รายการ', 'แห่ง'])} {r.choice(dry)}{r.choice(tail)}" for _ in range(200)]
    names += [f"ซื้อมาตรวัดน้ำ จำนวน {r.randrange(1, 40)} เครื่อง {r.choice(['', 'รถบรรทุก'])}" for _ in range(100)] + [None, "", "12 345"]
    groups = (("water", "มาตรวัดน้ำ"),)
    got = text.mine_terms(spark.createDataFrame([(n,) for n in names], "project_name string").repartition(4), groups).collect()
    want = mined(names, lambda n: "มาตรวัดน้ำ" in (n or ""))
    assert [(g.term, g.n, g.leak) for g in got] == want and len(want) >= 3


def test_tail_as_a_column(spark):
    rows = [(x, d) for d in (1, 2, 3, 8, 15) for x in (0.0, 0.01, 0.5, 1.0, 3.84, 7.0, 20.0, 45.0, 300.0)]
    for r in spark.createDataFrame(rows, "x double, d int").withColumn("p", digits.chi_squared_tail(F.col("x"), F.col("d"))).collect():
        assert r.p == pytest.approx(chi_squared_tail(r.x, r.d), abs=1e-9)


def test_sibling_chances_are_binomial(spark):
    """One method and band, two kinds of price: a branch's draws are binomial with its siblings' share."""
    rows = [("org", f"s{b}", "m", 20_000.0 if i < k else 20_001.0) for b, k in enumerate((3, 4, 5, 4, 12)) for i in range(20)] + [("few", f"s{b}", "m", 20_000.0) for b in range(4) for _ in range(20)]
    c = spark.createDataFrame(rows, "dept_key string, dept_sub_name string, purchase_method_name string, contract_price_agree double")
    got = {r["sub"]: r for r in digits.sibling_test(c, draws=20_000).collect()}
    assert set(got) == {f"s{b}" for b in range(5)}
    for b, k in enumerate((3, 4, 5, 4, 12)):
        p = (28 - k) / 80
        far = abs(k / 20 - p) - 1e-12
        exact = sum(math.comb(20, j) * p**j * (1 - p) ** (20 - j) for j in range(21) if abs(j / 20 - p) >= far)
        assert got[f"s{b}"].p == pytest.approx(exact, abs=0.015)
    again = {r["sub"]: r.p for r in digits.sibling_test(c.repartition(5), draws=20_000).collect()}
    assert again == {k: r.p for k, r in got.items()}

"""Tests of the digits of prices: against Benford's law, against contracts of like kind, and of branches against their siblings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import round_kind
from ..tables import written
from .analytics import benford_test, significant_share

# Kinds of rounding, and bounds of log10 of the price between bands.
KINDS = ("000", "x00", "xx0", "xxx")
BANDS = (5.3, 5.7, 6.5)
LEAST_PRICE = 1000
DRAWS = 2000
#: Contracts of a cell up to which each is drawn alone, and as many drawn together as a byte counts.
EACH, TOGETHER = 48, 128
#: Branches that a task draws for.
BRANCHES = 1000


def chi_squared_tail(x: Column, degrees: Column, most: int = 40) -> Column:
    """P(chi-squared > x) for degrees from 1 to `most`, one less the series of the lower incomplete gamma function; below 1e-12
    where x is over 60 + 4 times the degrees."""
    a, half = degrees / 2, x / 2
    gamma = F.array(*[F.lit(math.lgamma(d / 2 + 1)) for d in range(1, most + 1)])
    first = F.exp(a * F.log(half) - half - F.get(gamma, (degrees - 1).cast("int")))
    start = F.struct(first.alias("term"), first.alias("sum"))
    add = lambda s, i: F.struct((s["term"] * half / (a + i)).alias("term"), (s["sum"] + s["term"] * half / (a + i)).alias("sum"))
    lower = F.aggregate(F.sequence(F.lit(1), F.lit(400)), start, add)["sum"]
    return F.when(x <= 0, 1.0).when(x > 60 + 4 * degrees, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - lower))


def priced(c: DataFrame) -> DataFrame:
    """Contracts of LEAST_PRICE and more with kind, how far the price is rounded, and band, its size."""
    size = F.log10(F.col("contract_price_agree").cast("double"))
    band = sum((F.when(size > b, 1).otherwise(0) for b in BANDS), F.lit(0))
    return c.filter(F.col("contract_price_agree") >= LEAST_PRICE).withColumns({"kind": round_kind(F.col("contract_price_agree")), "band": band})


def peer_test(c: DataFrame, least: int = 20) -> DataFrame:
    """Agencies of enough contracts: chi-squared of their kinds of rounding against what the contracts of like method, type and
    band lead one to expect, over kinds of which one is expected at least, and its chance."""
    rows = priced(c).withColumn("peer", F.concat_ws("|", F.coalesce("purchase_method_name", F.lit("")), F.coalesce("project_type_name", F.lit("")), F.col("band")))
    counts = written(rows.groupBy("dept_key", "peer").pivot("kind", list(KINDS)).agg(F.count(F.lit(1))).na.fill(0))
    own = sum(F.col(k) for k in KINDS)
    peers = counts.groupBy("peer").agg(*[F.sum(k).alias(f"_{k}") for k in KINDS])
    joined = counts.join(peers, "peer")
    everyone = sum(F.col(f"_{k}") for k in KINDS)
    told = joined.groupBy("dept_key").agg(*[F.sum(k).alias(f"o_{k}") for k in KINDS], *[F.sum(own * F.col(f"_{k}") / everyone).alias(f"e_{k}") for k in KINDS])
    n = sum(F.col(f"o_{k}") for k in KINDS)
    enough = [F.col(f"e_{k}") >= 1 for k in KINDS]
    stat = sum((F.when(p, F.pow(F.col(f"o_{k}") - F.col(f"e_{k}"), F.lit(2)) / F.col(f"e_{k}")).otherwise(0.0) for k, p in zip(KINDS, enough)), F.lit(0.0))
    degrees = F.greatest(sum((F.when(p, 1).otherwise(0) for p in enough), F.lit(0)) - 1, F.lit(1))
    out = told.filter(n >= least).select("dept_key", n.alias("n"), stat.alias("chi_squared"), degrees.alias("degrees"))
    return out.withColumn("p", chi_squared_tail(F.col("chi_squared"), F.col("degrees")))


def _drawn(rng: np.random.Generator, n: np.ndarray, share: np.ndarray, draws: int) -> np.ndarray:
    """A column per draw: how many contracts are of each kind, of cells of n contracts each by the cell's shares. Contracts of small
    cells are drawn one by one, as cheap numbers compared with bounds; a cell of many costs no more than one multinomial."""
    few = n <= EACH
    out = np.zeros((len(KINDS), draws), np.int64)
    for k, p in zip(n[~few], share[~few]):
        out += rng.multinomial(k, p, draws).T
    upto = np.repeat(share[few].cumsum(1)[:, :-1], n[few], axis=0)
    for at in range(0, len(upto), TOGETHER):
        part = upto[at : at + TOGETHER]
        x = rng.random((len(part), draws))
        below = [np.add.reduce((x < b[:, None]).view(np.uint8), axis=0, dtype=np.uint8) for b in part.T]
        out += np.diff(np.array(below, np.int64), axis=0, prepend=0, append=len(part))
    return out


def _chances(draws: int, seed: int):
    """Rows of a branch (by cell its own counts and its siblings', end to end) to the share of draws that are as far from expectation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for org, sub, lot, own, siblings in zip(b["org"], b["sub"], b["lot"], b["own"], b["siblings"]):
                own, share = own.reshape(-1, len(KINDS)), siblings.reshape(-1, len(KINDS)).astype(float)
                n, seen = own.sum(1), own.astype(float).sum(0)
                share /= share.sum(1, keepdims=True)
                expected = (n[:, None] * share).sum(0) / n.sum()
                apart = np.abs(seen / n.sum() - expected).mean()
                rng = np.random.Generator(np.random.SFC64((seed, lot & 0xFFFFFFFF, lot >> 32 & 0xFFFFFFFF)))
                far = np.abs(_drawn(rng, n, share, draws) / n.sum() - expected[:, None]).mean(0)
                out.append((org, sub, int(n.sum()), float(apart), float((far >= apart - 1e-12).mean())))
            yield pd.DataFrame(out, columns=["org", "sub", "n", "mad", "p"])

    return run


def sibling_test(c: DataFrame, org: str = "dept_key", sub: str = "dept_sub_name", least: int = 15, siblings: int = 5, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """org, sub, n, mad, p of the branches of enough contracts in organisations of enough such branches: how far a branch's
    kinds of rounding lie from those of its siblings within like method and band, and the share of seeded draws that lie as far.

    Draws need a cell's counts only, so a row per branch is all that they read. A branch's seed comes from its
    names, so results don't hang on how rows are dealt.
    """
    rows = priced(c).select(F.col(org).cast("string").alias("org"), F.col(sub).cast("string").alias("sub"), F.concat_ws("|", F.coalesce("purchase_method_name", F.lit("")), F.col("band")).alias("cell"), "kind")
    counts = written(rows.groupBy("org", "sub", "cell").pivot("kind", list(KINDS)).agg(F.count(F.lit(1))).na.fill(0))
    branches = written(counts.groupBy("org", "sub").agg(F.sort_array(F.collect_list(F.struct("cell", F.array(*KINDS).alias("own")))).alias("cells"), F.sum(sum(F.col(k) for k in KINDS)).alias("n")).filter(F.col("n") >= least))
    orgs = branches.groupBy("org").agg(F.count("*").alias("k")).filter(F.col("k") >= siblings).select("org")
    # A row per organisation, with as many entries as it has cells; branches meet it whole, without being dealt by cell.
    whole = counts.groupBy("org", "cell").agg(F.array(*[F.sum(k) for k in KINDS]).alias("all")).groupBy("org").agg(F.map_from_entries(F.collect_list(F.struct("cell", "all"))).alias("whole"))
    both = branches.join(written(whole.join(orgs, "org", "left_semi")), "org")
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    each = F.transform("cells", lambda x: F.struct(x["own"].alias("own"), F.zip_with(F.col("whole")[x["cell"]], x["own"], lambda a, o: a - o).alias("siblings")))
    # Cells that siblings don't have tell nothing; a branch needs enough contracts in the others.
    known = both.select("org", "sub", F.filter(each, lambda x: total(x["siblings"]) > 0).alias("x")).select("org", "sub", F.flatten("x.own").alias("own"), F.flatten("x.siblings").alias("siblings"))
    known = known.filter(total(F.col("own")) >= least).select("org", "sub", F.xxhash64("org", "sub").alias("lot"), "own", "siblings")
    # Rows are small and draws are not: tasks are dealt by branches, not by bytes.
    tasks = max(c.sparkSession.sparkContext.defaultParallelism, -(-branches.count() // BRANCHES))
    return known.repartition(tasks, "org", "sub").mapInPandas(_chances(draws, seed), "org string, sub string, n long, mad double, p double")


def audit(c: DataFrame, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """A row per test: how many were tested, the share with p under 0.05, and the share that stays significant at that rate of false discoveries."""
    benford = benford_test(c.filter(F.col("contract_price_agree") >= LEAST_PRICE)).select(F.col("p_value").alias("p"))
    parts = []
    for name, p in (("benford", benford), ("peer", peer_test(c).select("p")), ("sibling", sibling_test(c, draws=draws, seed=seed).select("p"))):
        p = written(p)
        plain = p.agg(F.count("p").alias("tested"), F.round(F.count_if(F.col("p") < 0.05) / F.count("p"), 6).alias("share_p05")).withColumn("_one", F.lit(1))
        found = significant_share(p, "p").select(F.round(F.col("n_significant") / F.col("n_tests"), 6).alias("share_bh"), F.lit(1).alias("_one"))
        parts.append(plain.join(found, "_one").select(F.lit(name).alias("test"), "tested", "share_p05", "share_bh"))
    return reduce(DataFrame.unionByName, parts)

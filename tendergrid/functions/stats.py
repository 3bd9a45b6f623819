"""Beta posteriors, robust scales and ranks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..tables import written


def beta_tail(x: np.ndarray, a: np.ndarray, b: np.ndarray, nodes: int = 96) -> np.ndarray:
    """P(Beta(a, b) > x) by Gauss-Legendre over the logit, where the density has no poles, on both sides of x."""
    x = np.clip(np.asarray(x, float), 1e-12, 1 - 1e-12)
    a, b = np.asarray(a, float), np.asarray(b, float)
    at, weight = np.polynomial.legendre.leggauss(nodes)
    split = np.log(x / (1 - x))
    mode = np.log(a / b)
    spread = np.sqrt(1 / a + 1 / b)
    low, high = mode - 12 * spread - 40 / np.minimum(a, 40), mode + 12 * spread + 40 / np.minimum(b, 40)

    def mass(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        total = np.zeros_like(a)
        for part in range(16):
            p, q = lo + (hi - lo) * part / 16, lo + (hi - lo) * (part + 1) / 16
            t = (p + q)[:, None] / 2 + (q - p)[:, None] / 2 * at
            log_density = a[:, None] * (t - mode[:, None]) - (a + b)[:, None] * (np.logaddexp(0, t) - np.logaddexp(0, mode)[:, None])
            total += (np.exp(log_density) * weight).sum(1) * np.maximum(q - p, 0) / 2
        return total

    above = mass(np.clip(split, low, high), high)
    below = mass(low, np.clip(split, low, high))
    return above / (above + below)


@F.pandas_udf(DoubleType())
def beta_survival(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """P(Beta(a, b) > x); for frames of one row per agency or cell."""
    ok = x.notna() & a.notna() & b.notna()
    out = pd.Series(np.nan, index=x.index)
    if ok.any():
        out[ok] = beta_tail(x[ok].to_numpy(), a[ok].to_numpy(), b[ok].to_numpy())
    return out.where(ok, None)


def beta_prior(groups: DataFrame, k: str, n: str, by: list[str] | None = None) -> DataFrame:
    """A row (alpha, beta), or one for each value of `by`: moments of the groups' rates weighted by size; (1, 1) where
    there is no group with rows or no rate but 0 or 1."""
    some = groups.filter(F.col(n) > 0).select(*(by or []), F.col(k).cast("double").alias("k"), F.col(n).cast("double").alias("n"))
    sums = some.groupBy(*(by or [])).agg(F.sum("k").alias("sk"), F.sum("n").alias("sn"), F.count("*").alias("g"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("skk"))
    mean = F.col("sk") / F.col("sn")
    seen = F.col("skk") / F.col("sn") - mean * mean
    drawn = mean * (1 - mean) * F.col("g") / F.col("sn")
    between = F.greatest(seen - drawn, F.lit(1e-6))
    size = F.least(F.lit(1e4), F.greatest(F.lit(2.0), mean * (1 - mean) / between - 1))
    none = F.coalesce(F.col("sn"), F.lit(0.0)) == 0
    flat = (F.col("sk") <= 0) | (F.col("sk") >= F.col("sn"))
    one = F.lit(1.0)
    clamp = lambda v: F.greatest(F.lit(1e-3), v)
    return sums.select(*(by or []), F.when(none | flat, one).otherwise(clamp(mean * size)).alias("alpha"), F.when(none | flat, one).otherwise(clamp((1 - mean) * size)).alias("beta"))


def with_posterior(groups: DataFrame, k: str, n: str, by: list[str] | None = None) -> DataFrame:
    """groups with alpha and beta of each one's posterior; a prior for all is two numbers read on the driver."""
    if by:
        known = groups.join(beta_prior(groups, k, n, by).withColumnsRenamed({"alpha": "_a", "beta": "_b"}), by)
    else:
        a, b = beta_prior(groups, k, n).first()
        known = groups.withColumns({"_a": F.lit(a), "_b": F.lit(b)})
    return known.withColumn("alpha", F.col("_a") + F.col(k)).withColumn("beta", F.col("_b") + F.col(n) - F.col(k)).drop("_a", "_b")


def running(counts: DataFrame, by: list[str], x: str, sums: list[str]) -> DataFrame:
    """counts, a row for each group and x, with c_before (the sum over the group's rows of lower x) and c_all for each column c
    of sums. Rows are dealt into ranges and sorted within each; a range starts where those before it end, so that no
    task sorts a whole group."""
    dealt = written(counts.repartitionByRange(*[F.col(c) for c in (*by, x)]).withColumn("_range", F.spark_partition_id()))
    # As many rows as ranges and groups together.
    sizes = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    ahead = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_range").alias("_at"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_start_{c}") for c in sums], *[F.sum(c).over(group).alias(f"{c}_all") for c in sums])
    same = [F.col("_range") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]]
    own = W.partitionBy(*by, "_range").orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(starts, same)
    return out.select(*counts.columns, *[(F.col(f"_start_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"{c}_before") for c in sums], *[f"{c}_all" for c in sums])


def _coarse(x: Column) -> Column:
    """A number that never falls as x grows: the sign and the 64th of an octave that x lies in. NaN comes last, as in Spark's order."""
    step = F.floor(F.least(F.log2(F.abs(x)), F.lit(1100.0)) * 64).cast("double") + 100_000
    return F.when(F.isnan(x), 1e9).when(x == 0, 0.0).otherwise(F.signum(x) * step)


def quantiles(df: DataFrame, x: str, by: list[str], shares: dict[str, float], lies: bool = False) -> DataFrame:
    """by, n and a column per share: exact quantiles of x within groups, interpolated between neighbours; nulls don't
    count. A histogram of coarse steps tells in which steps a group's quantiles lie; only values of those steps are counted
    one by one and sorted in ranges (running). Values are written for the two passes, but where df lies in a table already
    and nothing is shuffled to read it."""
    values = df.filter(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"))
    values = values if lies else written(values)
    steps = values.groupBy(*by, _coarse(F.col("_x")).alias("_step")).agg(F.count("*").alias("_c"))
    # As many rows as a group has steps, however many values.
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_c").over(group.orderBy("_step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = steps.withColumns({"_ahead": before, "n": F.sum("_c").over(group)})
    holds = lambda place: (F.col("_ahead") <= place) & (F.col("_ahead") + F.col("_c") > place)
    wanted = F.lit(False)
    for share in shares.values():
        place = (F.col("n") - 1) * share
        wanted = wanted | holds(F.floor(place)) | holds(F.ceil(place))
    told = placed.filter(wanted).select(*[F.col(c).alias(f"_is_{c}") for c in by], F.col("_step").alias("_is_step"), "_ahead", "n")
    same = [_coarse(F.col("_x")) == F.col("_is_step"), *[F.col(c).eqNullSafe(F.col(f"_is_{c}")) for c in by]]
    counts = values.join(told, same).groupBy(*by, "_ahead", "n", "_x").agg(F.count("*").alias("_k"))
    upto = running(counts, [*by, "_ahead"], "_x", ["_k"]).withColumn("_upto", F.col("_ahead") + F.col("_k_before") + F.col("_k"))
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_x")))
    found = {}
    for name, share in shares.items():
        place = (F.col("n") - 1) * share
        found |= {f"_lo_{name}": at(F.floor(place)), f"_hi_{name}": at(F.ceil(place)), f"_part_{name}": F.max(place - F.floor(place))}
    out = upto.groupBy(*by).agg(F.max("n").alias("n"), *[c.alias(k) for k, c in found.items()])
    return out.select(*by, "n", *[(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_part_{k}")).alias(k) for k in shares])


def percent_rank_average(df: DataFrame, x: str, by: list[str], out: str) -> DataFrame:
    """df with the rank of x, ties averaged, as a share of the group's rows; nulls have none. Ranks are found for the
    distinct values, from their counts."""
    counts = running(df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_k")), by, x, ["_k"])
    share = (F.col("_k_before") + (F.col("_k") + 1) / 2) / F.col("_k_all")
    return df.join(counts.select(*by, x, share.alias(out)), [*by, x], "left")


def places(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with the place of each row, from 0, in an order over all rows: the rows are dealt into ranges, and each
    range starts where those before it end."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = written(df.repartitionByRange(*cols).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # A row per range.
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*cols)) - 1
    return dealt.withColumn("_own", own).join(starts.select("_range", "_start"), "_range").withColumn(out, F.col("_start") + F.col("_own")).drop("_range", "_own", "_start")


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row (n, n_positive, auc): the chance that a labelled row scores above another, ties half, from the counts of
    distinct scores."""
    counts = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count_if(label).alias("_p"), F.count_if(~F.col(label)).alias("_q"))
    won = running(counts, [], "_s", ["_q"]).withColumn("_won", F.col("_p") * (F.col("_q_before") + F.col("_q") / 2))
    return won.agg(F.sum(F.col("_p") + F.col("_q")).alias("n"), F.sum("_p").alias("n_positive"), F.when((F.sum("_p") > 0) & (F.sum("_q") > 0), F.round(F.sum("_won") / (F.sum("_p") * F.sum("_q")), 6)).alias("auc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of the two columns' ranks, ties averaged."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    ranked = percent_rank_average(percent_rank_average(both, "_a", [], "_ra"), "_b", [], "_rb")
    return ranked.agg(F.round(F.corr("_ra", "_rb"), 6).alias("spearman"), F.count("*").alias("n"))


def correlation_of_logs(df: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """One row: Pearson's correlation of the logarithms over rows where both are positive; null for fewer than `least`."""
    both = df.filter((F.col(a) > 0) & (F.col(b) > 0))
    return both.agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= least, F.corr(F.log(F.col(a).cast("double")), F.log(F.col(b).cast("double")))), 6).alias("corr"))


def robust_z(df: DataFrame, x: str, by: list[str], out: str) -> DataFrame:
    """(x - median) / (1.4826 MAD) within groups, the spread of all rows where a group has none, clipped to 10."""
    # Written, medians of few groups are known to be small: rows meet them where they lie, and no task takes a whole group.
    centre = written(quantiles(df, x, by, {"_m": 0.5}).drop("n"))
    apart = df.join(centre, by).withColumn("_d", F.abs(F.col(x) - F.col("_m")))
    spread = written(quantiles(apart, "_d", by, {"_s": 0.5}).drop("n"))
    whole = quantiles(df, x, [], {"m": 0.5}).first()
    whole = df.withColumn("_w", F.abs(F.col(x) - F.lit(whole["m"] if whole else None)))
    all_spread = (quantiles(whole, "_w", [], {"m": 0.5}).first() or {"m": 0})["m"] or 1.0
    z = (F.col(x) - F.col("_m")) / (1.4826 * F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(all_spread)))
    return apart.join(spread, by).withColumn(out, F.least(F.lit(10.0), F.greatest(F.lit(-10.0), z))).drop("_m", "_d", "_s")


def robust_z_of(df: DataFrame, columns: list[str], by: list[str], of: DataFrame | None = None) -> DataFrame:
    """df with each of the columns as robust z within groups (null is a group), as robust_z() has it for one. Medians and spreads
    of all columns come from one pass each, of the rows of df, or of `of`: the same rows, lying in a table (see quantiles)."""
    lies = of is not None
    of = df if of is None else of
    keys = [F.col(b).alias(f"_of_{b}") for b in by]
    same = lambda: [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]

    def middles(rows: DataFrame, values: list[Column], name: str, by: list[str]) -> DataFrame:
        """A row per group with the medians of the values as an array."""
        long = rows.select(*by, F.posexplode(F.array(*values)).alias("_f", "_v"))
        found = quantiles(long, "_v", [*by, "_f"], {"m": 0.5}, lies)
        as_map = F.map_from_entries(F.collect_list(F.struct("_f", "m")))
        return found.groupBy(*by).agg(as_map.alias(name))

    names = [F.col(c).cast("double") for c in columns]
    centre = written(middles(of, names, "_m", by).select(*keys, "_m"))
    apart = df.join(centre, same(), "left").drop(*[f"_of_{b}" for b in by])
    of_apart = of.join(centre, same(), "left").drop(*[f"_of_{b}" for b in by])
    spread = written(middles(of_apart, [F.abs(v - F.col("_m")[F.lit(i)]) for i, v in enumerate(names)], "_s", by).select(*keys, "_s"), wide=True)
    whole = [1.0] * len(columns)
    if spread.filter(F.exists(F.map_values("_s"), lambda v: v * 1.4826 <= 1e-9)).limit(1).count():
        of_all = middles(of, names, "_m", []).first()
        found = of_all and middles(of, [F.abs(v - F.lit(of_all["_m"].get(i))) for i, v in enumerate(names)], "_s", []).first()
        whole = [((found["_s"].get(i) if found else 0) or 0) * 1.4826 or 1.0 for i in range(len(columns))]
    out = apart.join(spread, same(), "left")
    scale = [1.4826 * F.col("_s")[F.lit(i)] for i in range(len(columns))]
    z = {c: (v - F.col("_m")[F.lit(i)]) / F.when(s > 1e-9, s).otherwise(F.lit(whole[i])) for i, (c, v, s) in enumerate(zip(columns, names, scale))}
    return out.withColumns({c: F.least(F.lit(10.0), F.greatest(F.lit(-10.0), v)) for c, v in z.items()}).drop("_m", "_s", *[f"_of_{b}" for b in by])


def chi_squared_tail(x: float, degrees: int) -> float:
    """P(chi-squared > x) by its series or continued recurrences on half-integers."""
    if x <= 0:
        return 1.0
    half = x / 2
    if degrees % 2 == 0:
        term = total = math.exp(-half)
        for i in range(1, degrees // 2):
            term *= half / i
            total += term
        return total
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) / math.sqrt(math.pi * half) * half / 0.5
    for i in range(1, degrees // 2 + 1):
        total += term
        term *= half / (i + 0.5)
    return total

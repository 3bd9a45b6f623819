"""What works cost a unit, against what their size and kind make likely.

The line is a median regression, log(price per unit) on log(size) and kind. It is fitted by Newton steps on a smoothed
sum of absolute residuals, sqrt(r^2 + e^2), while e halves from round to round. A round is one pass over the rows where
they lie: each partition adds up, for some candidate coefficients, the objective and the sums of products for the next
step, and what reaches the driver is one row of these sums, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import first_group, road_area
from ..functions.stats import quantiles
from ..functions.values import COMBINED_SCOPE, CONSTRUCTION_TYPE, OTHER_SURFACE, SURFACES
from ..tables import written
from .reports import line_km

#: Rounds of the fit; the smoothing ends at 2^-ROUNDS of the mean residual.
ROUNDS = 26
LEAST_ROWS, LEAST_OF_KIND, MOST_KINDS = 30, 5, 64
FLAG_Z = 2.5


def _totals(rows: DataFrame, x: list[str], kinds: list, candidates: np.ndarray, now: float, after: float) -> np.ndarray:
    """Sums over rows (y, x, kind) for each candidate: objective at smoothing `now`, then gradient, second derivatives
    and weighted products at `after`."""
    width = candidates.shape[1]

    size = 1 + width + 2 * width * width
    first = 1 + len(x)

    def products(w: np.ndarray, xs: list[np.ndarray], kind: np.ndarray) -> np.ndarray:
        """design.T @ (design * w) from sums per kind: the kinds' columns are 0 but for their own rows."""
        out = np.zeros((width, width))
        by_kind = np.bincount(kind, w, len(kinds) + 1)
        out[0, 0] = by_kind.sum()
        out[0, first:] = out[first:, 0] = by_kind[1:]
        out[range(first, width), range(first, width)] = by_kind[1:]
        for i, own in enumerate(xs, 1):
            weighted = w * own
            by_kind = np.bincount(kind, weighted, len(kinds) + 1)
            out[0, i] = out[i, 0] = by_kind.sum()
            out[i, first:] = out[first:, i] = by_kind[1:]
            for j in range(i):
                out[i, j + 1] = out[j + 1, i] = weighted @ xs[j]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(candidates), size))
        for batch in batches:
            y, *xs = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(first))
            # 0 is the base.
            kind = batch.column(first).to_numpy(zero_copy_only=False) + 1
            for at, b in enumerate(candidates):
                r = y - np.concatenate([[0.0], b[first:]]).take(kind) - b[0]
                for own, slope in zip(xs, b[1:]):
                    r -= slope * own
                square = r * r
                near = 1 / np.sqrt(square + after * after)
                g = r * near
                by_kind = np.bincount(kind, g, len(kinds) + 1)
                gradient = [by_kind.sum(), *[g @ own for own in xs], *by_kind[1:]]
                curved = products(near * near * near * (after * after), xs, kind)
                total[at] += np.concatenate([[np.sqrt(square + now * now).sum()], gradient, curved.ravel(), products(near, xs, kind).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "part"])

    # Each partition sends as many rows as there are sums; they are added where they meet.
    sums = rows.select("y", *x, "kind").mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("s")).collect()
    out = np.zeros((len(candidates), size))
    for r in sums:
        out.flat[r["at"]] = r["s"]
    return out


def median_regression(rows: DataFrame, y: str, x: list[str], kind: str | None = None, kinds: list | None = None, rounds: int = ROUNDS) -> np.ndarray | None:
    """Coefficients of the least sum of absolute residuals: the constant, each of x, and each of kinds but those not
    listed, which are the base. Rows with a null count for nothing; None if no row is left. Where several lines are as
    good, as with an even number of rows, one of them is returned."""
    kinds = kinds or []
    index = F.coalesce(*[F.when(F.col(kind).eqNullSafe(k), F.lit(i)) for i, k in enumerate(kinds)], F.lit(-1)) if kinds else F.lit(-1)
    whole = [F.col(c).cast("double") for c in (y, *x)]
    base = rows.select(whole[0].alias("y"), *[w.alias(f"x{i}") for i, w in enumerate(whole[1:])], index.alias("kind"))
    names = [f"x{i}" for i in range(len(x))]
    base = written(base.dropna(), split_mb=4)
    # Scaled columns keep the sums well conditioned.
    told = base.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in names for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    if not told["n"]:
        return None
    mean, sd = np.array([told[f"mean_{c}"] for c in names]), np.array([told[f"sd_{c}"] or 1.0 for c in names])
    base = base.withColumns({c: (F.col(c) - float(m)) / float(d) for c, m, d in zip(names, mean, sd)})
    width = 1 + len(x) + len(kinds)
    b = np.zeros(width)
    b[0] = quantiles(base, "y", [], {"m": 0.5}).first()["m"]
    e = _totals(base, names, kinds, b[None, :], 0.0, 1.0)[0, 0] / told["n"]
    if e == 0:
        return _unscaled(b, mean, sd)
    tried, now = b[None, :], e
    for _ in range(rounds):
        sums = _totals(base, names, kinds, tried, now, now / 2)
        best = int(np.argmin(sums[:, 0]))
        b, rest, now = tried[best], sums[best, 1:], now / 2
        gradient, second, weighted = rest[:width], rest[width : width + width * width].reshape(width, width), rest[width + width * width :].reshape(width, width)
        step = lambda m: np.linalg.solve(m + np.eye(width) * 1e-10 * max(np.trace(m), 1e-300), gradient)
        newton, plain = step(second), step(weighted)
        tried = np.array([b, *[b + t * newton for t in (1, 0.5, 0.25, 0.1, 0.03)], *[b + t * plain for t in (1, 2, 4)]])
    sums = _totals(base, names, kinds, tried, 0.0, now)
    return _unscaled(tried[int(np.argmin(sums[:, 0]))], mean, sd)


def _unscaled(b: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    out = b.copy()
    out[1 : 1 + len(sd)] = b[1 : 1 + len(sd)] / sd
    out[0] -= (out[1 : 1 + len(sd)] * mean).sum()
    return out


def road_works(c: DataFrame) -> DataFrame:
    """Rows of c that build roads, with area (square metres as the name states, 20 to 500,000), surface, and combined:
    whether the price covers drains or the like too."""
    name = F.coalesce(F.col("project_name"), F.lit(""))
    surface = F.coalesce(*[F.when(name.rlike(p), F.lit(k)) for k, p in SURFACES], F.lit(OTHER_SURFACE))
    roads = c.filter((first_group(F.col("project_name")) == "road") & (F.col("project_type_name") == CONSTRUCTION_TYPE) & (F.col("contract_price_agree") > 0))
    return roads.withColumns({"area": road_area(F.col("project_name")), "surface": surface, "combined": name.rlike(COMBINED_SCOPE)}).filter("area >= 20 and area <= 500000")


def quantity_checks(roads: DataFrame, length_m: Column, wkt: Column) -> DataFrame:
    """One row: whether drawn lines (20 m to 50 km) or the lengths in names say more of the price: correlations of
    logarithms, null under ten rows, and how many times as long the line is in the median."""
    km = line_km(F.when(F.upper(wkt).startswith("LINESTRING"), wkt))
    rows = roads.select(F.col("contract_price_agree").cast("double").alias("price"), F.when((km > 0.02) & (km < 50), km).alias("km"), F.when(length_m > 0, length_m).alias("m"))
    both = F.col("km").isNotNull() & F.col("m").isNotNull()
    corr = lambda a, b, on: F.round(F.when(F.count_if(on) >= 10, F.corr(F.when(on, F.log(a)), F.when(on, F.log(b)))), 3)
    ratio = quantiles(rows.filter(both).withColumn("ratio", F.col("km") * 1000 / F.col("m")), "ratio", [], {"median": 0.5}).select(F.lit(1).alias("_one"), F.round("median", 2).alias("geometry_vs_name_ratio"))
    line = F.col("km").isNotNull()
    told = rows.agg(F.count("km").alias("geometry_n"), corr(F.col("price"), F.col("km"), line).alias("geometry_corr_price"), F.count_if(both).alias("geometry_vs_name_n"), corr(F.col("km"), F.col("m"), both).alias("geometry_vs_name_corr"))
    return told.withColumn("_one", F.lit(1)).join(ratio, "_one", "left").drop("_one")


def unit_costs(works: DataFrame, price: str, size: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(works, kinds). works: the rows with a positive price and size, with per_unit, expected_per_unit and cost_z, how
    many robust spreads the logarithm of the price per unit lies from the line; null where fewer than LEAST_ROWS rows
    make a line. kinds: per kind its rows, median price per unit, effect (times the base's price at the same size; the
    base is the commonest kind, and kinds of fewer than LEAST_OF_KIND rows count as it), elasticity, and flags on either side."""
    rows = works.filter((F.col(price) > 0) & (F.col(size) > 0)).withColumn("per_unit", F.col(price).cast("double") / F.col(size).cast("double"))
    rows = written(rows.withColumns({"_y": F.log("per_unit"), "_x": F.log(F.col(size).cast("double"))}))
    counts = rows.groupBy(F.col(kind).alias("k")).agg(F.count("*").alias("n"))
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    listed = [r["k"] for r in counts.filter(F.col("n") >= LEAST_OF_KIND).orderBy(F.desc("n"), F.asc_nulls_first("k")).limit(MOST_KINDS + 2).collect()][1:]
    if len(listed) > MOST_KINDS:
        raise ValueError(f"over {MOST_KINDS} kinds: class them first")
    b = median_regression(rows, "_y", ["_x"], kind, listed) if n >= LEAST_ROWS else None
    effect = F.coalesce(*[F.when(F.col(kind).eqNullSafe(k), F.lit(float(v))) for k, v in zip(listed, b[2:])], F.lit(0.0)) if b is not None and listed else F.lit(0.0)
    line = F.lit(None).cast("double") if b is None else float(b[0]) + float(b[1]) * F.col("_x") + effect
    told = rows.withColumn("expected_per_unit", F.exp(line)).withColumn("_r", F.col("_y") - line)
    # Two numbers, known to all rows: a join on a constant would send every row to one task.
    middle = quantiles(told, "_r", [], {"m": 0.5}).first()
    off = F.abs(F.col("_r") - F.lit(middle and middle["m"]).cast("double"))
    spread = quantiles(told.withColumn("_off", off), "_off", [], {"s": 0.5}).first()
    mad = (F.lit(spread and spread["s"]) * 1.4826).cast("double")
    z = F.when(mad > 0, F.col("_r") / mad).otherwise(F.when(F.col("_r").isNotNull(), F.lit(0.0)))
    out = told.withColumn("cost_z", z)
    middles = quantiles(told, "per_unit", [kind], {"median_per_unit": 0.5}).drop("n")
    each = out.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(F.col("cost_z") >= FLAG_Z).alias("n_high"), F.count_if(F.col("cost_z") <= -FLAG_Z).alias("n_low"), F.max(mad).alias("mad_log"))
    joined = each.join(middles.withColumnRenamed(kind, "_k"), F.col(kind).eqNullSafe(F.col("_k")), "left").drop("_k")
    fitted = F.lit(b is not None)
    kinds = joined.withColumns({"effect": F.when(fitted, F.exp(effect)), "elasticity": F.lit(None if b is None else float(b[1])).cast("double")})
    return out.drop("_r", "_x", "_y"), kinds

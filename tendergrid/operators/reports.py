"""Top lists, shares, ranks of scores against each other, filters and quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parse import haversine_km
from ..functions.stats import auc, percent_rank_average, quantiles
from ..tables import written

#: The group of groups that are too small for one of their own.
OTHER = "other_small"
# Words of units in written numbers, and words that may stand beside a number.
UNITS = (("พันล้าน", 1_000_000_000), ("ล้าน", 1_000_000), ("พัน", 1_000))
BESIDE = "บาท|วัน|สัญญา|ฉบับ|ราย|หน่วยงาน|เท่า|ของมัธยฐาน"


def top_n(df: DataFrame, value: str, n: int, ties: list[str]) -> DataFrame:
    """The n rows of the greatest value, each with its percentage of what is shown; ties in order of the given columns."""
    shown = df.orderBy(F.desc(value), *ties).limit(n)
    # n rows.
    return shown.withColumn("share_pct", F.round(100 * F.col(value) / F.sum(value).over(W.partitionBy(F.lit(0))), 2))


def ranked_contractors(stats: DataFrame, scores: DataFrame, top: int = 15) -> DataFrame:
    """Winners by how many archetypes they show (wide doesn't count), then mean score, then value."""
    n = F.size(F.filter("archetypes", lambda a: a != "wide"))
    both = stats.join(scores.groupBy("winner_key").agg(F.round(F.avg("risk_score"), 4).alias("avg_score")), "winner_key", "left").withColumn("n_archetypes", n)
    return both.orderBy(F.desc("n_archetypes"), F.desc("avg_score"), F.desc("value"), "winner_key").limit(top)


def top_overlap(a: DataFrame, b: DataFrame, key: list[str], k: int) -> DataFrame:
    """One row: how many of two lists of k rows are in both, and as a share of k."""
    both = a.select(*key).join(b.select(*key), key, "left_semi")
    return both.agg(F.count("*").alias("n_both"), F.round(F.count("*") / k, 6).alias("overlap"))


def top_factors(parts: Column, least: float, most: int = 3) -> Column:
    """Of an array of structs (feature, delta, ...) those of the greatest delta above a bound; ties in order of feature."""
    big = F.filter(parts, lambda p: p["delta"] > least)
    order = F.array_sort(big, lambda x, y: F.when(x["delta"] > y["delta"], -1).when(x["delta"] < y["delta"], 1).when(x["feature"] < y["feature"], -1).when(x["feature"] > y["feature"], 1).otherwise(0))
    return F.slice(order, 1, most)


def group_percentile(df: DataFrame, x: str, by: list[str], out: str) -> DataFrame:
    """df with the percentile of x within its group, ties averaged, to one place."""
    return percent_rank_average(df, x, by, "_share").withColumn(out, F.round(100 * F.col("_share"), 1)).drop("_share")


def scoring_groups(df: DataFrame, group: str, least: int = 30, other: str = OTHER) -> DataFrame:
    """df with scoring_group: its group, or `other` where the group has fewer usable rows."""
    # Written, it is known to be small: rows meet it where they lie.
    sizes = written(df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n")))
    joined = df.join(sizes, F.col(group).eqNullSafe(F.col("_g")), "left")
    return joined.withColumn("scoring_group", F.when(F.col("_n") >= least, F.col(group)).otherwise(F.lit(other))).drop("_n", "_g")


def group_middles(df: DataFrame, x: str, by: list[str]) -> tuple[DataFrame, float | None]:
    """The medians of x by group, keys as _of_<key>, and that of all, taken only where a group has none."""
    groups = written(quantiles(df, x, by, {"_m": 0.5}).select(*[F.col(b).alias(f"_of_{b}") for b in by], "_m"))
    lacking = not df.select(*by).distinct().join(groups, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by], "left_anti").isEmpty()
    whole = quantiles(df, x, [], {"m": 0.5}).first() if lacking else None
    return groups, whole["m"] if whole else None


def imputed(df: DataFrame, x: str, by: list[str], out: str, middles: tuple[DataFrame, float | None] | None = None) -> DataFrame:
    """df with x, or its group's median, or that of all where x or a group has none. middles: those of group_middles()."""
    groups, whole = middles or group_middles(df, x, by)
    same = [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]
    return df.join(groups, same, "left").withColumn(out, F.coalesce(F.col(x).cast("double"), "_m", F.lit(whole))).drop("_m", *[f"_of_{b}" for b in by])


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per bin of equal width from low to high; what lies outside falls into the first or last."""
    at = F.least(F.greatest(F.floor((F.col(x) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(x).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def modes(df: DataFrame, by: str, x: str) -> DataFrame:
    """The commonest value of x per group, the smallest of those that tie."""
    return df.groupBy(by).agg(F.mode(x, True).alias("mode"))


def variation(df: DataFrame, by: str, x: str, least: int = 5) -> DataFrame:
    """Per group of enough rows the sample deviation of x over its mean; 0 where the mean is 0."""
    value = F.col(x).cast("double")
    out = df.filter(value.isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")).filter(F.col("n") >= least)
    return out.select(by, "n", F.round(F.when(F.col("_m") != 0, F.col("_s") / F.col("_m")).otherwise(0.0), 6).alias("cv"))


def share_bands(shares: DataFrame, share: str, mid: float = 45, high: float = 70) -> DataFrame:
    """shares with band: high, mid or low by a percentage."""
    return shares.withColumn("band", F.when(F.col(share) >= high, "high").when(F.col(share) >= mid, "mid").otherwise("low"))


def agreement(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Rows by how many engines flag them, and by the only one that does."""
    on = {k: F.coalesce(p, F.lit(False)).cast("int") for k, p in flags.items()}
    marked = df.select(*[v.alias(k) for k, v in on.items()]).withColumn("n_agree", reduce(lambda a, b: a + b, [F.col(k) for k in on]))
    sole = F.when(F.col("n_agree") == 1, F.coalesce(*[F.when(F.col(k) == 1, F.lit(k)) for k in on])).otherwise("")
    return marked.groupBy("n_agree", sole.alias("sole")).agg(F.count("*").alias("n"))


def proxy_evaluation(df: DataFrame, label: str, score: str, ties: list[str], cuts: tuple[int, ...] = (100, 500)) -> DataFrame:
    """One row: how well a score ranks labelled rows: precision among the first of each cut, AUC, base rate."""
    first = df.filter(F.col(score).isNotNull()).orderBy(F.desc(score), *ties).limit(max(cuts)).select(label, score, *ties)
    # As many rows as the greatest cut.
    placed = first.withColumn("_at", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(score), *ties)))
    precision = placed.agg(*[F.round(F.count_if(F.col(label) & (F.col("_at") <= k)) / F.least(F.count("*"), F.lit(k)), 6).alias(f"precision_{k}") for k in cuts])
    whole = auc(df, label, score).withColumn("base_rate", F.round(F.col("n_positive") / F.col("n"), 6))
    return whole.withColumn("_one", F.lit(1)).join(precision.withColumn("_one", F.lit(1)), "_one").drop("_one")


def edge_filter(edges: DataFrame, least_n: int = 0, least_value: float = 0.0, flagged_only: bool = False, agency: str | None = None, winner=None) -> DataFrame:
    """Edges of the agency-winner network that satisfy all of the conditions given."""
    keep = (F.col("n") >= least_n) & (F.col("value") >= least_value)
    if flagged_only:
        keep = keep & (F.col("flagged") > 0)
    if agency is not None:
        keep = keep & (F.col("source") == agency)
    if winner is not None:
        keep = keep & (F.col("target") == winner)
    return edges.filter(keep)


def within(c: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Contracts placed inside a box of the map, its edges included."""
    return c.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def deep_filter(df: DataFrame, percentile: str, mode: str, others: list[str] | None = None, group: str | None = None, value=None) -> DataFrame:
    """Rows of a score's tab: ge99, ge95, agree (another engine is at 95 too) or only (none is), of one group or all."""
    high = F.col(percentile) >= 95
    other = reduce(lambda a, b: a | b, [F.coalesce(F.col(o) >= 95, F.lit(False)) for o in others or []], F.lit(False))
    keep = {"ge99": F.col(percentile) >= 99, "ge95": high, "agree": high & other, "only": high & ~other}[mode]
    return df.filter(keep if group is None else keep & (F.col(group) == value))


def written_number(text: Column) -> Column:
    """A number as written in a table cell: thousands separators, a unit (the first of UNITS found, taken out once), words
    beside it; null for any other text."""
    bare = F.trim(text)
    factor, left = F.lit(1.0), bare
    for word, times in reversed(UNITS):
        factor = F.when(bare.contains(word), F.lit(float(times))).otherwise(factor)
    for word, _ in reversed(UNITS):
        left = F.when(bare.contains(word), F.regexp_replace(bare, f"(?s)^(.*?){word}", "$1")).otherwise(left)
    plain = F.regexp_replace(F.regexp_replace(left, r"[,%×\s]", ""), BESIDE, "")
    number = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
    return F.when(plain.rlike(number), plain.cast("double") * factor)


def number_key(x: Column) -> Column:
    """A number as a key: an integral one without decimals."""
    return F.when(x.cast("double") == F.floor(x.cast("double")), F.floor(x.cast("double")).cast("string")).otherwise(x.cast("double").cast("string"))


def cart_key(*parts: str) -> Column:
    """The key by which scores from elsewhere meet contracts: the parts joined by a bar, nulls empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def line_km(wkt: Column) -> Column:
    """Length of a line's stretches on the sphere; 0 for a single point, null without any."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(wkt, F.lit("")), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda n: n.cast("double"))
    n = F.floor(F.size(numbers) / 2).cast("int")
    steps = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i < n), lambda i: haversine_km(F.get(numbers, 2 * i - 1), F.get(numbers, 2 * i - 2), F.get(numbers, 2 * i + 1), F.get(numbers, 2 * i)))
    return F.when(n >= 1, F.aggregate(steps, F.lit(0.0), lambda a, b: a + b))


def quality_report(c: DataFrame, fields: list[str], key: list[str]) -> DataFrame:
    """One row: rows, filled share of each field, repeated keys, range of dates, negative prices, backward dates."""
    filled = [F.round(F.count_if(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")) / F.count("*"), 6).alias(f"filled_{f}") for f in fields]
    repeated = c.groupBy(*key).agg(F.count("*").alias("_k")).agg(F.count("*").alias("n_keys"), F.sum(F.col("_k") - 1).alias("n_repeated"))
    whole = c.agg(F.count("*").alias("n"), *filled, F.min("contract_date").alias("first_date"), F.max("contract_date").alias("last_date"), F.count_if(F.col("contract_price_agree") < 0).alias("n_negative"), F.count_if(F.col("contract_finish_date") < F.col("contract_date")).alias("n_backward"))
    # One row each.
    return whole.withColumn("_one", F.lit(1)).join(repeated.withColumn("_one", F.lit(1)), "_one").drop("_one")


def backward_dates(c: DataFrame, n: int = 50) -> DataFrame:
    """Contracts that end before they begin, the longest first."""
    return c.filter("duration_days < 0").orderBy("duration_days", "project_id", "contract_no", "winner_key", "contract_date").limit(n).select("project_id", "contract_no", "winner_key", "contract_date", "duration_days")


def contract_timing(c: DataFrame, least: int = 3) -> DataFrame:
    """Per fiscal year from October: contracts, the median days from announcement, those without a date, and days on
    which an agency signs several."""
    year = F.coalesce(F.year(F.add_months("contract_date", 3)), F.lit(0)).alias("fiscal_year")
    own = c.groupBy(year).agg(F.count("*").alias("n"), F.count_if(F.col("contract_date").isNull()).alias("undated"), F.count("announce_gap_days").alias("n_gaps"))
    gaps = quantiles(c.select(year, "announce_gap_days"), "announce_gap_days", ["fiscal_year"], {"gap_median": 0.5}).drop("n")
    days = c.filter(F.col("contract_date").isNotNull()).groupBy(year, "dept_key", "contract_date").agg(F.count("*").alias("_k")).filter(F.col("_k") >= least)
    busy = days.groupBy("fiscal_year").agg(F.count("*").alias("busy_days"), F.max("_k").alias("peak"))
    return own.join(gaps, "fiscal_year", "left").join(busy, "fiscal_year", "left").na.fill(0, ["busy_days", "peak"])


def rolled_up(c: DataFrame, *levels: str) -> DataFrame:
    """Contracts and value of every node of a tree of columns, from the whole down; depth 0 is the whole."""
    depth = len(levels) - reduce(lambda a, b: a + b, [F.grouping(x) for x in levels])
    return c.rollup(*levels).agg(depth.cast("int").alias("depth"), F.count("*").alias("n"), F.sum("contract_price_agree").cast("double").alias("value"))


def sibling_shares(c: DataFrame, org: str, sub: str, flag: Column, least: int = 15, siblings: int = 5) -> DataFrame:
    """Branches of an organisation: their share of flagged contracts against that of the organisation's other branches,
    which is the organisation's total less their own."""
    own = c.groupBy(org, sub).agg(F.count("*").alias("n"), F.count_if(flag).alias("k")).filter(F.col("n") >= least)
    all_ = own.groupBy(org).agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"), F.count("*").alias("_subs")).filter(F.col("_subs") >= siblings)
    return own.join(all_, org).select(org, sub, "n", F.round(F.col("k") / F.col("n"), 6).alias("share"), F.round((F.col("_k") - F.col("k")) / (F.col("_n") - F.col("n")), 6).alias("sibling_share"))


def peer_expectation(c: DataFrame, by: str, kind: Column, peers: list[str], least: int = 20) -> DataFrame:
    """Per group and kind of price how many contracts it has, and how many its contracts' peers lead one to expect."""
    rows = c.select(by, *[p for p in peers if p != by], kind.alias("kind"))
    cell = rows.groupBy(*peers, "kind").agg(F.count("*").alias("_k"))
    size = cell.groupBy(*peers).agg(F.sum("_k").alias("_n"))
    own = rows.groupBy(by, *[p for p in peers if p != by]).agg(F.count("*").alias("_own"))
    expected = own.join(cell, peers).join(size, peers).groupBy(by, "kind").agg(F.sum(F.col("_own") * F.col("_k") / F.col("_n")).alias("expected"))
    seen = rows.groupBy(by, "kind").agg(F.count("*").alias("n"))
    enough = rows.groupBy(by).agg(F.count("*").alias("_all")).filter(F.col("_all") >= least).select(by)
    out = expected.join(seen, [by, "kind"], "left").join(enough, by, "left_semi")
    return out.select(by, "kind", F.coalesce("n", F.lit(0)).alias("n"), F.round("expected", 4).alias("expected"))


def agency_discounts(d: DataFrame, least: int = 5) -> DataFrame:
    """Per agency, from models.hurdle(): how far its contracts at exactly the reference price exceed what the model
    expects, in deviations, and how deep its other discounts are against like contracts."""
    zero = (F.abs(F.col("contract_price_agree").cast("double") / F.col("price_build").cast("double") - 1) < 1e-6).cast("double")
    own = d.groupBy("dept_key").agg(F.count("*").alias("n"), F.sum(zero).alias("_z"), F.sum("p_zero").alias("_p"), F.sum(F.col("p_zero") * (1 - F.col("p_zero"))).alias("_v"), F.count("depth_residual").alias("n_discount"), F.avg("depth_residual").alias("_r"))
    sigma = d.agg(F.stddev_pop("depth_residual")).first()[0] or 1.0
    own = own.filter(F.col("n") >= least)
    z = F.when(F.col("_v") > 0, (F.col("_z") - F.col("_p")) / F.sqrt("_v")).otherwise(0.0)
    depth = F.when(F.col("n_discount") >= 3, F.col("_r") / (F.lit(sigma) / F.sqrt("n_discount")))
    return own.select("dept_key", "n", F.col("_z").cast("long").alias("zero_seen"), F.round("_p", 1).alias("zero_expected"), F.round(z, 2).alias("zero_z"), "n_discount", F.round(depth, 2).alias("depth_z"))


def highlights(c: DataFrame, pairs: DataFrame, turns: DataFrame, spread: DataFrame, days: DataFrame) -> DataFrame:
    """One row of counts: mutual and loyal pairs, agencies with turns, pairs that split over days, busy days."""
    parts = [pairs.agg(F.count_if("mutual").alias("mutual_pairs"), F.count_if("loyal").alias("loyal_pairs")), turns.agg(F.count("*").alias("turn_agencies")), spread.agg(F.count("*").alias("split_pairs")), days.agg(F.count("*").alias("busy_days")), c.agg(F.count("*").alias("n"))]
    # One row each.
    return reduce(lambda a, b: a.join(b, "_one"), [p.withColumn("_one", F.lit(1)) for p in parts]).drop("_one")

"""Behaviour of contractors, pairs, days and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import quantiles
from ..functions.values import SPECIFIC_METHOD
from ..tables import written


# Classes of discount and their upper bounds.
DISCOUNT_BINS = (("none", 0.0005), ("to_1", 0.01), ("to_5", 0.05), ("to_15", 0.15), ("to_30", 0.3), ("over_30", None))


def _price() -> Column:
    return F.col("contract_price_agree")


def _day(c: str) -> Column:
    return F.unix_date(c)


def _share(part: str, whole: str) -> Column:
    """Part of a whole in value; 0 where there is no whole."""
    return F.coalesce(F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole).cast("double")), F.lit(0.0))


def single_contract_discount(c: DataFrame) -> DataFrame:
    """c with discount, 1 - price / reference price, for priced contracts that are their project's only one."""
    if "p_n" in c.columns:
        joined = c.filter(F.col("project_id").isNotNull()).withColumn("_n", F.col("p_n"))
    else:
        joined = c.join(c.groupBy("project_id").agg(F.count("*").alias("_n")), "project_id")
    ratio = F.when((F.col("_n") == 1) & (F.col("price_build") > 0) & (_price() > 0), 1 - _price().cast("double") / F.col("price_build").cast("double"))
    return joined.withColumn("discount", ratio).drop("_n")


def bursts(c: DataFrame, by: list[str], days: int = 30) -> DataFrame:
    """Most contracts of each group within any so many days, both ends counted."""
    w = W.partitionBy(*by).orderBy(_day("contract_date")).rangeBetween(-days, 0)
    dated = c.filter(F.col("contract_date").isNotNull()).select(*by, F.count("*").over(w).alias("n"))
    return dated.groupBy(*by).agg(F.max("n").alias("burst"), F.count("*").alias("n_contracts"))


def spread_splits(c: DataFrame, days: int = 30, each_below: float = 500_000, total_at: float = 500_000) -> DataFrame:
    """Pairs whose small contracts within some days come to the ceiling. Two different days are asked of the pair, not of the days."""
    key = ["dept_key", "winner_key"]
    small = c.filter((_price() > 0) & (_price() < each_below) & F.col("contract_date").isNotNull())
    w = W.partitionBy(*key).orderBy(_day("contract_date")).rangeBetween(-days, 0)
    seen = small.select(*key, "contract_date", F.sum("contract_price_agree").over(w).alias("total"), F.count("*").over(w).alias("n"))
    out = seen.groupBy(*key).agg(F.max(F.when(F.col("n") >= 2, F.col("total"))).alias("max_total"), F.max("n").alias("max_n"), F.count_distinct("contract_date").alias("n_days"))
    return out.filter((F.col("max_total") >= total_at) & (F.col("n_days") >= 2)).select(*key, F.col("max_total").cast("double").alias("max_total"), "max_n", "n_days")


def rotation(c: DataFrame, least: int = 6, top: int = 3, least_coverage: float = 0.7, least_switches: float = 0.6) -> DataFrame:
    """Agencies whose top winners take turns: their share of contracts, and how often the winner changes from one to the next."""
    dated = c.filter(F.col("contract_date").isNotNull())
    pairs = dated.groupBy("dept_key", "winner_key").agg(F.count("*").alias("n"))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("dept_key").orderBy(F.desc("n"), "winner_key"))).withColumn("dept_n", F.sum("n").over(W.partitionBy("dept_key")))
    leading = ranked.filter((F.col("rank") <= top) & (F.col("dept_n") >= least))
    order = W.partitionBy("dept_key").orderBy("contract_date", "project_id", "contract_no", "winner_key", "contract_price_agree")
    turns = dated.join(leading.select("dept_key", "winner_key", "dept_n"), ["dept_key", "winner_key"]).withColumn("before", F.lag("winner_key").over(order))
    out = turns.groupBy("dept_key").agg(F.count("*").alias("n"), F.first("dept_n").alias("dept_n"), F.count_if(F.col("before") != F.col("winner_key")).alias("switches"))
    out = out.filter(F.col("n") >= least).withColumn("coverage", F.round(F.col("n") / F.col("dept_n"), 6)).withColumn("switch_share", F.round(F.col("switches") / (F.col("n") - 1), 6))
    return out.filter((F.col("coverage") >= least_coverage) & (F.col("switch_share") >= least_switches)).select("dept_key", "n", "dept_n", "switches", "coverage", "switch_share")


def pair_patterns(c: DataFrame, least: int = 3) -> DataFrame:
    """Pairs with their share of the agency's and of the winner's value; mutual where both are a half or more."""
    own = c.groupBy("dept_key", "winner_key").agg(F.count("*").alias("n"), F.sum("contract_price_agree").alias("value"), F.min("contract_date").alias("first"), F.max("contract_date").alias("last"), F.count_if(F.col("purchase_method_name") == SPECIFIC_METHOD).alias("specific"))
    # Pairs are read three times, contracts once.
    own = written(own)
    dept, winner = own.groupBy("dept_key").agg(F.sum("value").alias("dept_value")), own.groupBy("winner_key").agg(F.sum("value").alias("winner_value"))
    out = own.join(dept, "dept_key").join(winner, "winner_key").filter(F.col("n") >= least)
    a, b = _share("value", "dept_value"), _share("value", "winner_value")
    return out.select("dept_key", "winner_key", "n", F.col("value").cast("double").alias("value"), F.round(a, 6).alias("share_of_agency"), F.round(b, 6).alias("share_of_winner"), F.datediff("last", "first").alias("span_days"), F.round(F.col("specific") / F.col("n"), 6).alias("specific_share"), ((a >= 0.5) & (b >= 0.5)).alias("mutual"), (F.col("n") >= 4).alias("loyal"))


def monthly(c: DataFrame) -> DataFrame:
    """Contracts and value per month against the mean month; months are few, so the mean is a window over them."""
    months = c.filter(F.col("contract_date").isNotNull()).groupBy(F.date_format("contract_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("contract_price_agree").cast("double").alias("value"))
    return months.withColumn("vs_mean", F.round(F.col("n") / F.avg("n").over(W.partitionBy(F.lit(0))), 6))


def weekdays(c: DataFrame) -> DataFrame:
    days = c.filter(F.col("contract_date").isNotNull()).groupBy((F.dayofweek("contract_date") - 1).alias("weekday")).agg(F.count("*").alias("n"), F.count_if(F.day("contract_date") >= 25).alias("n_month_end"))
    return days.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 6))


def same_day(c: DataFrame, least: int = 5) -> DataFrame:
    """Days on which an agency signs many contracts."""
    days = c.filter(F.col("contract_date").isNotNull()).groupBy("dept_key", "contract_date").agg(F.count("*").alias("n"), F.count_distinct("winner_key").alias("n_winners"), F.sum("contract_price_agree").cast("double").alias("value"))
    return days.filter(F.col("n") >= least)


def discount_bins(c: DataFrame) -> DataFrame:
    """Comparable contracts per class of discount, classes closed above, and their share; classes without any too."""
    d = F.col("discount")
    below = -float("inf")
    counts, at = [], below
    for name, upto in DISCOUNT_BINS:
        counts.append(F.count_if((d > at if at != below else F.lit(True)) & (d <= upto if upto is not None else F.lit(True))).alias(name))
        at = upto
    whole = single_contract_discount(c).filter(d.isNotNull()).agg(F.count("*").alias("_all"), *counts)
    rows = F.array(*[F.struct(F.lit(name).alias("bin"), F.col(name).alias("n")) for name, _ in DISCOUNT_BINS])
    return whole.select("_all", F.explode(rows).alias("x")).select("x.bin", "x.n", F.round(F.coalesce(F.col("x.n") / F.nullif("_all", F.lit(0)), F.lit(0.0)), 6).alias("share"))


def method_prices(c: DataFrame, least: int = 20) -> DataFrame:
    """Median discount, and share of contracts without one, per method with enough comparable contracts."""
    d = single_contract_discount(c).filter(F.col("discount").isNotNull()).select("purchase_method_name", "discount")
    out = d.groupBy("purchase_method_name").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("discount") <= DISCOUNT_BINS[0][1]) / F.count("*"), 6).alias("zero_share"))
    middle = quantiles(d, "discount", ["purchase_method_name"], {"m": 0.5})
    middle = middle.select(F.col("purchase_method_name").alias("_method"), F.round("m", 3).alias("median_discount"))
    return out.filter(F.col("n") >= least).join(middle, F.col("purchase_method_name").eqNullSafe(F.col("_method"))).drop("_method")


def round_prices(c: DataFrame, ceiling: float = 500_000) -> DataFrame:
    """One row: contracts just under and just over the ceiling with their ratio, and shares of round prices."""
    p = _price()
    below, above = F.count_if((p >= ceiling * 0.9) & (p < ceiling)), F.count_if((p >= ceiling) & (p < ceiling * 1.1))
    share = lambda m: F.round(F.coalesce(F.count_if((p > 0) & (p % m == 0)) / F.nullif(F.count_if(p > 0), F.lit(0)), F.lit(0.0)), 6)
    counted = c.agg(below.alias("below"), above.alias("above"), share(10_000).alias("round_10k"), share(100_000).alias("round_100k"))
    return counted.withColumn("ratio", F.round(F.col("below") / F.nullif("above", F.lit(0)), 6))


def same_price_groups(c: DataFrame, least: int = 3, winners: int = 2) -> DataFrame:
    groups = c.filter(_price() > 0).groupBy("dept_key", "contract_price_agree").agg(F.count("*").alias("n"), F.count_distinct("winner_key").alias("n_winners"))
    return groups.filter((F.col("n") >= least) & (F.col("n_winners") >= winners)).withColumn("contract_price_agree", _price().cast("double"))


def contractors(c: DataFrame, least: int = 3, ceiling: float = 500_000) -> DataFrame:
    """Per winner: agencies, the one of most value and its share of it, discounts of all and of competed contracts, closeness
    to the ceiling, the most contracts from one agency in 30 days, and the archetypes that these make."""
    d = single_contract_discount(c)
    competed = (F.col("purchase_method_name") != SPECIFIC_METHOD) & F.col("discount").isNotNull()
    near = (_price() >= ceiling * 0.9) & (_price() < ceiling)
    own = d.groupBy("winner_key").agg(
        F.count("*").alias("n"), F.sum("contract_price_agree").alias("value"), F.count_if(F.col("purchase_method_name") == SPECIFIC_METHOD).alias("specific"),
        F.count_if(competed).alias("n_competed"), F.count_if(competed & (F.col("discount") <= 0.005)).alias("n_hug"), F.count("discount").alias("n_discounts"), F.count_if(F.col("discount") <= 0.005).alias("n_hug_all"), F.coalesce(F.bool_or("tin_is_masked"), F.lit(False)).alias("masked"), F.count_if(near).alias("n_near"), F.min("contract_date").alias("first_date"), F.max("contract_date").alias("last_date"),
    ).filter(F.col("n") >= least)
    each = c.groupBy("winner_key", "dept_key").agg(F.coalesce(F.sum("contract_price_agree"), F.lit(0)).alias("v"))
    top = each.groupBy("winner_key").agg(F.max("v").alias("top_value"), F.min_by("dept_key", F.struct(-F.col("v"), "dept_key")).alias("top_agency"), F.count("*").alias("n_agencies"))
    burst = bursts(c, ["winner_key", "dept_key"]).groupBy("winner_key").agg(F.max("burst").alias("burst30"))
    middle = quantiles(d, "discount", ["winner_key"], {"m": 0.5}).select("winner_key", F.round("m", 6).alias("median_discount"))
    out = own.join(top, "winner_key").join(middle, "winner_key", "left").join(burst, "winner_key", "left").withColumn("burst30", F.coalesce("burst30", F.lit(0)))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    out = out.select("winner_key", "n", F.col("value").cast("double").alias("value"), "n_agencies", "top_agency", F.round(_share("top_value", "value"), 6).alias("top_agency_share"), share("specific", "n").alias("specific_share"), "median_discount", "n_competed", share("n_hug", "n_competed").alias("ceiling_hug"), "n_discounts", share("n_hug_all", "n_discounts").alias("ceiling_hug_all"), "masked", share("n_near", "n").alias("near_ceiling"), "burst30", "first_date", "last_date")
    kinds = [("captive", (F.col("n") >= 8) & (F.col("top_agency_share") >= 0.8)), ("ceiling_hug", (F.col("n_competed") >= 3) & (F.col("ceiling_hug") >= 0.5)), ("under_ceiling", (F.col("n") >= 3) & (F.col("near_ceiling") >= 0.4)), ("burst", F.col("burst30") >= 5), ("specific_heavy", (F.col("n") >= 5) & (F.col("specific_share") >= 0.9)), ("wide", F.col("n_agencies") >= 8)]
    return out.withColumn("archetypes", F.array_compact(F.array(*[F.when(p, k) for k, p in kinds])))


def archetype_counts(stats: DataFrame) -> DataFrame:
    return stats.select(F.explode("archetypes").alias("archetype"), "value").groupBy("archetype").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))

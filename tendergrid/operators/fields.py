"""Derived fields of contracts, which user rules may name: what a project, a winner, and an agency with it are like."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import method_group
from ..functions.values import SPECIFIC_METHOD
from ..tables import written
from .patterns import bursts, contractors

#: Types of fields that a table may lack; there they are null.
PLAIN = dict.fromkeys(("contract_price_agree", "price_build", "project_money", "duration_days", "announce_gap_days", "ml_pct", "risk_score", "pair_n"), "double") | dict.fromkeys(("is_jv", "tin_is_masked"), "boolean")
#: Fields that come from a join, by what is joined.
_WINNERS = ("contractor_n_contracts", "contractor_n_agencies", "contractor_top_agency_share")
_PAIRS = ("pair_n_contracts", "pair_share_of_agency")
JOINED = ("discount_pct", "project_n_contracts", *_PAIRS, *_WINNERS, "contractor_specific_share", "contractor_burst30", "contractor_archetype")
DERIVED = (*JOINED, "contract_day", "month_end", "weekend", "method_group", "geo")


def of_the_row(name: str) -> Column | None:
    """A derived field that the contract's own columns give; None for any other."""
    day = F.day("contract_date")
    return {
        "contract_day": day, "month_end": F.coalesce(day >= 25, F.lit(False)), "weekend": F.coalesce(F.dayofweek("contract_date").isin(1, 7), F.lit(False)), "method_group": method_group(F.col("purchase_method_name")),
        "geo": F.when(F.col("lat").isNull(), "none").when(F.col("geo_quality") == "shared", "shared").otherwise("ok"),
    }.get(name)


def with_fields(rows: DataFrame, c: DataFrame, named: Iterable[str], ceiling: float = 500_000) -> DataFrame:
    """rows, which are c or c with more columns, with the derived fields that are named. Only what these need is
    aggregated and joined; a name that is neither derived nor a column of rows becomes a null one. Shares are of value, but for specific_share, and rounded to three places."""
    wanted, out = set(named) - set(rows.columns), rows
    price = F.coalesce(F.col("contract_price_agree").cast("double"), F.lit(0.0))
    if wanted & {"discount_pct", "project_n_contracts"}:
        if "p_n" in out.columns:
            out = out.withColumn("project_n_contracts", F.col("p_n"))
        else:
            out = out.join(c.groupBy("project_id").agg(F.count("*").alias("project_n_contracts")), "project_id", "left")
    if "discount_pct" in wanted:
        build = F.col("price_build").cast("double")
        out = out.withColumn("discount_pct", F.when((F.col("project_n_contracts") == 1) & (build > 0) & (price > 0), F.round((1 - price / build) * 100, 1)))
    pairs = c.groupBy("dept_key", "winner_key").agg(F.count("*").alias("pair_n_contracts"), F.sum(price).alias("_pair_value"))
    if wanted & {*_PAIRS, *_WINNERS}:
        pairs = written(pairs)
    if wanted & set(_PAIRS):
        agencies = pairs.groupBy("dept_key").agg(F.sum("_pair_value").alias("_agency_value"))
        share = F.coalesce(F.round(F.col("_pair_value") / F.nullif(F.col("_agency_value"), F.lit(0.0)), 3), F.lit(0.0))
        # An agency's total meets its pairs, not its contracts: these would meet in a task per agency.
        out = out.join(pairs.join(agencies, "dept_key"), ["dept_key", "winner_key"], "left").withColumn("pair_share_of_agency", share)
    if wanted & set(_WINNERS):
        top = F.round(F.max("_pair_value") / F.nullif(F.sum("_pair_value"), F.lit(0.0)), 3)
        out = out.join(pairs.groupBy("winner_key").agg(F.sum("pair_n_contracts").alias(_WINNERS[0]), F.count_distinct("dept_key").alias(_WINNERS[1]), top.alias(_WINNERS[2])), "winner_key", "left")
    if "contractor_specific_share" in wanted:
        share = F.round(F.count_if(F.col("purchase_method_name") == SPECIFIC_METHOD) / F.count("*"), 3)
        out = out.join(c.groupBy("winner_key").agg(share.alias("contractor_specific_share")), "winner_key", "left")
    if "contractor_burst30" in wanted:
        burst = bursts(c, ["dept_key", "winner_key"]).groupBy("winner_key").agg(F.max("burst").alias("contractor_burst30"))
        out = out.join(burst, "winner_key", "left").withColumn("contractor_burst30", F.coalesce("contractor_burst30", F.lit(1).cast("long")))
    if "contractor_archetype" in wanted:
        kinds = contractors(c, least=1, ceiling=ceiling).select("winner_key", F.col("archetypes").alias("contractor_archetype"))
        out = out.join(kinds, "winner_key", "left").withColumn("contractor_archetype", F.coalesce("contractor_archetype", F.array().cast("array<string>")))
    lacking = [f for f in wanted if f not in DERIVED and f not in out.columns]
    out = out.withColumns({f: F.lit(None).cast(PLAIN.get(f, "string")) for f in lacking}) if lacking else out
    own = {f: of_the_row(f) for f in DERIVED if f in wanted and f not in JOINED}
    out = out.withColumns(own) if own else out
    hidden = {"_pair_value", "_agency_value"} | ({"project_n_contracts", *_PAIRS, *_WINNERS} - wanted - set(rows.columns))
    return out.drop(*hidden)


def lab_fields(c: DataFrame, ceiling: float = 500_000) -> DataFrame:
    """c with all derived fields: discount in percent, the project's size, the day signed, and what the winner and the
    pair are like."""
    return with_fields(c, c, DERIVED, ceiling)

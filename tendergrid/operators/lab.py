"""The rule laboratory: derived fields of contracts, their vocabularies, traits, mined traits and the health of rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import written
from .fields import lab_fields  # noqa: F401
from .models import frequent_sets, least_count
from .rules import Rule, bit, configured, evaluate, hit_sets, score, struck, summarize

# The bounds of the value classes.
VALUE_BINS = (("to_100k", 0, 100_000), ("to_500k", 100_000, 500_000), ("to_2m", 500_000, 2_000_000), ("to_10m", 2_000_000, 10_000_000), ("over_10m", 10_000_000, None))
REDUNDANT = 0.5
PRIORITY_SCORE = 40


def vocabulary(c: DataFrame, field: str) -> DataFrame:
    """The distinct values of a field that are not blank, in order."""
    return c.select(F.col(field).cast("string").alias("value")).filter("value is not null and value != ''").distinct().orderBy("value")


def trait_items(fields: DataFrame) -> DataFrame:
    """Rows of lab_fields() with traits, the categorical items that describe a contract; wg: and jv where the table has
    work_group and is_jv."""
    price, d = F.coalesce(F.col("contract_price_agree").cast("double"), F.lit(0.0)), F.col("discount_pct")
    value_bin = F.coalesce(*[F.when((price >= lo) & (price < hi if hi else F.lit(True)), F.lit(f"vb:{name}")) for name, lo, hi in VALUE_BINS])
    single = {
        "near": (price >= 450_000) & (price < 500_000), "d0": d <= 0.05, "d1": (d > 0.05) & (d <= 1), "d15": d > 15, "multi": F.col("project_n_contracts") > 1, "wkend": F.col("weekend"), "mend": F.col("month_end"),
        "gshared": F.col("geo") == "shared", "tin": F.col("tin_is_masked"), "pair": (F.col("pair_share_of_agency") >= 0.5) & (F.col("pair_n_contracts") >= 3),
    }
    if "is_jv" in fields.columns:
        single["jv"] = F.col("is_jv")
    group = [F.when((F.col("work_group") != "") & (F.col("work_group") != "other"), F.concat(F.lit("wg:"), F.col("work_group")))] if "work_group" in fields.columns else []
    named = [*group, F.concat(F.lit("mg:"), F.col("method_group")), F.when(F.col("project_type_name") != "", F.concat(F.lit("pt:"), F.col("project_type_name"))), value_bin]
    found = F.array_compact(F.array(*named, *[F.when(p, F.lit(k)) for k, p in single.items()]))
    kinds = F.transform(F.filter("contractor_archetype", lambda a: a != "wide"), lambda a: F.concat(F.lit("ar:"), a))
    return fields.withColumn("traits", F.concat(found, kinds))


def mined_traits(rows: DataFrame, target: Column, least_rows: int = 30, least_confidence: float = 0.5, least_lift: float = 1.3, most: int = 3, slack: float = 0.03, top: int = 60) -> DataFrame:
    """Sets of up to `most` traits after which the target is common, from frequent sets of the traits with the target as
    one more item, counted over the different lists of them. A set is dropped where a part of it has a confidence that is at most `slack` lower."""
    goal = "\x00goal"
    items = F.array_sort(F.array_distinct(F.concat("traits", F.array_compact(F.array(F.when(target, F.lit(goal)))))))
    sets = written(rows.groupBy(items.alias("items")).agg(F.count("*").alias("n")))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.array_contains("items", goal), F.col("n"))), F.lit(0)).alias("hits")).first()
    base = total["hits"] / max(total["n"], 1)
    found = frequent_sets(sets, least_count(least_rows, total["n"]), most + 1)
    with_goal = found.filter(F.array_contains("items", goal)).select(F.array_sort(F.array_remove("items", goal)).alias("traits"), F.col("freq").alias("n_both")).filter(F.size("traits") > 0)
    alone = found.filter(~F.array_contains("items", goal)).select(F.array_sort("items").alias("traits"), F.col("freq").alias("n"))
    rules = with_goal.join(alone, "traits").withColumn("confidence", F.col("n_both") / F.col("n")).withColumn("lift", F.col("confidence") / F.lit(base or 1.0))
    rules = rules.filter((F.col("confidence") >= least_confidence) & (F.col("lift") >= least_lift))
    # Each set meets the sets with one trait fewer, which the table of frequent sets bounds.
    smaller = rules.select("traits", "confidence", F.explode(F.transform("traits", lambda t: F.array_remove("traits", t))).alias("part")).filter(F.size("part") > 0)
    better = smaller.join(rules.select(F.col("traits").alias("part"), F.col("confidence").alias("part_confidence")), "part").filter(F.col("part_confidence") >= F.col("confidence") - slack)
    kept = rules.join(better.select("traits").distinct(), "traits", "left_anti")
    out = kept.orderBy(F.desc("lift"), F.desc("n_both"), "traits").limit(top)
    return out.select(F.array_join("traits", ",").alias("traits"), "n", "n_both", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


def rule_health(evaluated: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Per enabled rule: hits and their value, contracts that it alone hits, priority contracts that would not be such
    without it, and silent: no hit at all. Scores without a rule are formed once for each set of rules that hit together."""
    rules = configured() if rules is None else rules
    rows = hit_sets(evaluated).withColumn("risk_score", score(rules, lambda r: struck(r.id)))
    without = {k: score({j: r for j, r in rules.items() if j != k}, lambda r: struck(r.id)) for k in rules}
    told = [F.when(struck(k), F.struct(F.lit(k).alias("rule_id"), (F.col("hit_mask") == bit(k)).alias("sole"), ((F.col("risk_score") >= PRIORITY_SCORE) & (w < PRIORITY_SCORE)).alias("leave"))) for k, w in without.items()]
    each = rows.select("n", "value", F.explode(F.array_compact(F.array(*told))).alias("t"))
    of = lambda p: F.coalesce(F.sum(F.when(F.col(p), F.col("n"))), F.lit(0))
    counts = each.groupBy(F.col("t.rule_id").alias("rule_id")).agg(F.sum("n").alias("hits"), of("t.sole").alias("sole"), of("t.leave").alias("leave_one_out"), F.sum("value").cast("double").alias("value"))
    every = evaluated.sparkSession.createDataFrame([(k, float(r.weight)) for k, r in rules.items()], "rule_id string, weight double")
    out = every.join(counts, "rule_id", "left").na.fill(0, ["hits", "sole", "leave_one_out"])
    return out.withColumn("value", F.coalesce("value", F.lit(0.0))).withColumn("silent", F.col("hits") == 0)


def redundant_rules(overlaps: DataFrame, least: float = REDUNDANT) -> DataFrame:
    """Pairs of rules, from rules.overlap(), that hit nearly the same contracts, the closest first."""
    return overlaps.filter(F.col("jaccard") >= least).orderBy(F.desc("jaccard"), "rule_a", "rule_b")


def readiness(c: DataFrame, fields: dict[str, Iterable[str]], order: list[str], rows: int = 2000) -> DataFrame:
    """Per rule, on import: no where a field that it reads is empty in the whole table, yes where it hits any of the first rows
    by order, evaluated as a table of their own, else maybe; with the hits there and the empty fields."""
    names = sorted({f for fs in fields.values() for f in fs})
    counts = c.agg(*[F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f) for f in names])
    empty = lambda fs: F.array_join(F.array_compact(F.array(*[F.when(F.col(f) == 0, F.lit(f)) for f in sorted(fs)])), ",")
    told = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule_id"), empty(fs).alias("missing")) for k, fs in fields.items()])).alias("x")).select("x.*")
    tried = summarize(evaluate(written(c.orderBy(*order).limit(rows)), configured(only=fields)))
    both = told.join(tried.select("rule_id", F.col("n").alias("n_hits")), "rule_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))
    return both.withColumn("status", F.when(F.col("missing") != "", "no").when(F.col("n_hits") > 0, "yes").otherwise("maybe"))


def by_category(evaluated: DataFrame, rules: dict[str, Rule] | None = None, by: str | None = None) -> DataFrame:
    """Distinct contracts, and their value, per category of rules (and value of `by`); a contract counts once in each."""
    rules = configured() if rules is None else rules
    found = F.array_distinct(F.array_compact(F.array(*[F.when(struck(k), F.lit(r.category)) for k, r in rules.items()])))
    keys = [by] if by else []
    each = hit_sets(evaluated, *keys).select(*keys, "n", "value", F.explode(found).alias("category"))
    return each.groupBy(*keys, "category").agg(F.sum("n").alias("n"), F.sum("value").cast("double").alias("value"))


def rank_categories(findings: DataFrame) -> DataFrame:
    """Findings (level, value, ...) in order: high before mid before low, then by value."""
    level = F.when(F.col("level") == "high", 0).when(F.col("level") == "mid", 1).otherwise(2)
    place = W.partitionBy(F.lit(0)).orderBy(level, F.desc("value"), "finding")
    return findings.withColumn("place", F.row_number().over(place))

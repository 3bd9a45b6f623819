"""The risk rules: each is a predicate and a description of what was found, over contracts with their context.

evaluate() plans only the contexts that the enabled rules need, adds the hits as one array column, and scores them:
within a family only the heaviest hit counts, unscored rules never do, and the sum stops at 100.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parse import band, haversine_km, min_notice_days, significant_round
from ..functions.values import EBIDDING_METHOD, SPECIFIC_METHOD
from ..tables import written
from . import context
from .fields import with_fields

#: Bits of the hit mask: R1 is bit 0; user rules C1, C2, ... follow from bit 24.
USER_BIT = 24
SEVERITIES = ("none", "low", "medium", "high", "critical")
LEAST_ROWS = 20


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    weight: float
    category: str
    predicate: Callable[[dict], Column]
    actual: Callable[[dict], Column]
    needs: tuple[str, ...] = ()
    family: str | None = None
    scored: bool = True
    enabled: bool = True
    thresholds: dict[str, float] = field(default_factory=dict)
    #: Least, most and step of each threshold, for sweeps.
    ranges: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    #: Rows that must exist for the rule to mean anything.
    applicable: Callable[[dict], Column] | None = None
    dimensions: tuple[str, ...] = ()
    stage: str = ""
    #: Derived fields that a user rule names; such rules are tested after all others, whose hits they may name.
    fields: tuple[str, ...] = ()
    custom: bool = False


def _ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null where either is null or b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def _number(x: Column, digits: int = 4) -> Column:
    return F.round(x.cast("double"), digits).cast("string")


def default_rules() -> dict[str, Rule]:
    price, money, build = F.col("contract_price_agree"), F.col("project_money"), F.col("price_build")
    total = F.col("p_total")
    discount_money = _ratio(money - total, money)
    discount_build = _ratio(build - total, build)
    to_build = _ratio(total, build)
    specific = F.col("purchase_method_name") == SPECIFIC_METHOD
    unmasked = ~F.col("tin_is_masked")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    notice = F.when(F.col("purchase_method_name") == EBIDDING_METHOD, min_notice_days(money))
    weekday = F.dayofweek("contract_date")
    rules = [
        Rule("R1", "medium", 15, "price", lambda t: discount_money >= t["pct"], lambda t: _number(discount_money), ("projects",), "discount", thresholds={"pct": 0.30}, ranges={"pct": (0.05, 0.90, 0.05)}, dimensions=("economy",), stage="award"),
        Rule("R2", "medium", 15, "price", lambda t: discount_build >= t["pct"], lambda t: _number(discount_build), ("projects",), "discount", thresholds={"pct": 0.30}, ranges={"pct": (0.05, 0.90, 0.05)}, dimensions=("economy", "integrity"), stage="award"),
        Rule("R3", "high", 20, "structure", lambda t: F.col("p_n") >= t["min"], lambda t: F.col("p_n").cast("string"), ("projects",), thresholds={"min": 2}, ranges={"min": (2, 20, 1)}, dimensions=("integrity", "efficiency"), stage="plan"),
        Rule("R4", "critical", 30, "price", lambda t: _ratio(total, money) > t["ratio"], lambda t: _number(_ratio(total, money)), ("projects",), thresholds={"ratio": 1.0}, ranges={"ratio": (1.0, 2.0, 0.05)}, dimensions=("economy",), stage="award"),
        Rule("R7", "high", 25, "contractor", lambda t: unmasked & ((F.col("tin_names") >= t["min"]) | (F.col("name_tins") >= t["min"])), lambda t: F.concat_ws("/", F.col("tin_names"), F.col("name_tins")), ("identities",), thresholds={"min": 2}, ranges={"min": (2, 10, 1)}, dimensions=("integrity",), stage="award"),
        Rule("R8", "medium", 10, "method", lambda t: (money > context.CEILING) & specific & (F.col("a_confidence") >= t["confidence"]), lambda t: _number(F.col("a_confidence")), ("agencies",), thresholds={"share": 0.30, "confidence": 0.90}, ranges={"share": (0.10, 0.90, 0.05), "confidence": (0.50, 0.99, 0.01)}, dimensions=("efficiency", "integrity"), stage="award"),
        Rule("R9", "low", 5, "price", lambda t: (price >= t["minValue"]) & significant_round(price.cast("double"), int(t["sig"])), lambda t: _number(price, 2), thresholds={"sig": 2, "minValue": 100_000}, ranges={"sig": (1, 4, 1), "minValue": (10_000, 5_000_000, 10_000)}, dimensions=("economy", "integrity"), stage="award"),
        Rule("R10", "critical", 25, "structure", lambda t: (F.col("g_n") >= t["minCount"]) & (F.col("g_priced") == F.col("g_n")) & (F.col("g_max") < t["maxEach"]) & (F.col("g_total") >= t["minTotal"]), lambda t: _number(F.col("g_total"), 2), ("groups",), "split", thresholds={"maxEach": 500_000, "minTotal": 400_000, "minCount": 2}, ranges={"maxEach": (100_000, 5_000_000, 50_000), "minTotal": (100_000, 10_000_000, 50_000), "minCount": (2, 10, 1)}, applicable=lambda t: price < t["maxEach"], dimensions=("integrity", "economy"), stage="plan"),
        Rule("R11", "high", 15, "data", lambda t: F.col("duration_days") < t["maxDays"], lambda t: F.col("duration_days").cast("string"), scored=False, thresholds={"maxDays": 0}, ranges={"maxDays": (-30, 30, 1)}, dimensions=("integrity",), stage="award"),
        Rule("R12", "high", 20, "method", lambda t: specific & (price >= t["ceiling"] * (1 - t["bandPct"])) & (price < t["ceiling"]), lambda t: _number(price, 2), thresholds={"ceiling": 500_000, "bandPct": 0.10}, ranges={"ceiling": (100_000, 5_000_000, 50_000), "bandPct": (0.01, 0.30, 0.01)}, applicable=lambda t: specific & (price < t["ceiling"]), dimensions=("integrity", "economy"), stage="plan"),
        Rule("R13", "medium", 15, "price", lambda t: to_build >= t["minRatio"] - 1e-9, lambda t: _number(to_build), ("projects",), "exact", thresholds={"minRatio": 1.0}, ranges={"minRatio": (0.95, 1.0, 0.005)}, dimensions=("integrity", "economy"), stage="award"),
        Rule("R14", "medium", 10, "price", lambda t: F.abs(_ratio(build - money, money)) <= t["tolerance"], lambda t: _number(_ratio(build, money)), thresholds={"tolerance": 0.001}, ranges={"tolerance": (0, 0.05, 0.001)}, dimensions=("economy", "integrity"), stage="plan"),
        Rule("R15", "medium", 15, "contractor", lambda t: F.col("pair_n") >= t["minPair"], lambda t: F.col("pair_n").cast("string"), ("pairs",), "pair", thresholds={"minPair": 5}, ranges={"minPair": (2, 60, 1)}, dimensions=("integrity", "economy"), stage="portfolio"),
        Rule("R16", "high", 20, "method", lambda t: F.col("announce_gap_days") < notice - t["bufferDays"], lambda t: F.col("announce_gap_days").cast("string"), thresholds={"bufferDays": 0}, ranges={"bufferDays": (0, 10, 1)}, applicable=lambda t: notice.isNotNull() & F.col("announce_gap_days").isNotNull(), dimensions=("efficiency", "integrity"), stage="award"),
        Rule("R17", "medium", 10, "geography", lambda t: F.coalesce(F.col("geo_quality") != "shared", F.lit(True)) & (km > t["maxKm"]) & F.coalesce(F.col("d_median_km") <= t["maxKm"], F.lit(True)), lambda t: _number(km, 1), ("places",), thresholds={"maxKm": 200}, ranges={"maxKm": (50, 800, 25)}, dimensions=("effectiveness", "integrity"), stage="post"),
        Rule("R18", "medium", 12, "price", lambda t: (F.abs(to_build - 1) < 1e-6) & (F.col("r_confidence") >= t["confidence"]), lambda t: _number(F.col("r_confidence")), ("projects", "cells"), "exact", thresholds={"minGapPts": 15, "confidence": 0.90}, ranges={"minGapPts": (3, 50, 1), "confidence": (0.50, 0.99, 0.01)}, dimensions=("economy",), stage="award"),
        Rule("R19", "medium", 12, "data", lambda t: (weekday == 1) | (F.lit(bool(t["includeSat"])) & (weekday == 7)), lambda t: weekday.cast("string"), thresholds={"includeSat": 1}, ranges={"includeSat": (0, 1, 1)}, dimensions=("integrity",), stage="award"),
        Rule("R20", "high", 20, "data", lambda t: F.col("no_n") >= t["min"], lambda t: F.col("no_n").cast("string"), ("numbers",), scored=False, thresholds={"min": 2}, ranges={"min": (2, 10, 1)}, dimensions=("integrity",), stage="award"),
        Rule("R21", "medium", 12, "data", lambda t: F.abs(_ratio(F.col("sum_price_agree") - total, F.col("sum_price_agree"))) > t["tol"], lambda t: _number(_ratio(total, F.col("sum_price_agree"))), ("projects",), scored=False, thresholds={"tol": 0.01}, ranges={"tol": (0, 0.2, 0.005)}, dimensions=("economy", "integrity"), stage="award"),
        Rule("R22", "medium", 12, "contractor", lambda t: unmasked & (F.col("w_depts") == 1) & (F.col("w_n") >= t["minContracts"]) & (F.col("w_value") >= t["minValue"]), lambda t: F.col("w_n").cast("string"), ("winners",), "pair", thresholds={"minContracts": 5, "minValue": 5_000_000}, ranges={"minContracts": (2, 30, 1), "minValue": (0, 200_000_000, 1_000_000)}, dimensions=("efficiency", "integrity"), stage="portfolio"),
        Rule("R23", "medium", 12, "structure", lambda t: F.col("g_projects") >= t["minProjects"], lambda t: F.col("g_projects").cast("string"), ("groups",), "split", thresholds={"minProjects": 2}, ranges={"minProjects": (2, 10, 1)}, dimensions=("integrity", "economy"), stage="plan"),
    ]
    return {r.id: r for r in rules}


def configured(settings: dict[str, dict] | None = None, only: Iterable[str] | None = None, custom: dict[str, Rule] | None = None) -> dict[str, Rule]:
    """The rules, and custom ones beside them, under settings, {id: {enabled, weight, thresholds}}; unknown ids, keys and
    types raise ValueError. only names the default rules that count."""
    rules = default_rules() | (custom or {})
    for rule_id, change in (settings or {}).items():
        if rule_id not in rules:
            raise ValueError(f"no rule {rule_id}")
        rule = rules[rule_id]
        for key, value in (change.get("thresholds") or {}).items():
            if key not in rule.thresholds or isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"{rule_id}: {key}={value!r}")
        rules[rule_id] = replace(rule, enabled=bool(change.get("enabled", True)), weight=float(change.get("weight", rule.weight)), thresholds=rule.thresholds | (change.get("thresholds") or {}))
    wanted = None if only is None else set(only)
    return {k: r for k, r in rules.items() if r.enabled and (wanted is None or r.custom or k in wanted)}


def save_settings(path: str, settings: dict[str, dict]) -> None:
    configured(settings)
    Path(path).write_text(json.dumps(settings, indent=1, sort_keys=True))


def load_settings(path: str) -> dict[str, dict]:
    settings = json.loads(Path(path).read_text())
    configured(settings)
    return settings


def enrich(c: DataFrame, rules: dict[str, Rule], early: dict[str, Column] | None = None) -> DataFrame:
    """c with the context columns that the rules need, and the columns `early`, which rest on the contract and its project:
    formed before rows are dealt for other contexts, they let go of the columns that they are made of."""
    needs = {n for r in rules.values() for n in r.needs}
    out = context.joined_projects(c) if "projects" in needs else c
    out = out.withColumns(early) if early else out
    # One pass over c counts who deals with whom; pairs, winners and identities are sums of it.
    dealings = context.dealings(c) if needs & {"pairs", "winners", "identities"} else None
    if "pairs" in needs:
        out = out.join(context.pairs(dealings), ["dept_key", "winner_key"], "left")
    if "groups" in needs:
        # Rows that are dealt by pair lie by group too.
        out = context.with_same_day_groups(out)
    if "winners" in needs:
        out = out.join(written(context.winners(dealings)), "winner_key", "left")
    # What is known of agencies, provinces and types is written first: its size is known then, and where it is small, rows meet it
    # where they lie instead of in a task per agency or province.
    if "numbers" in needs:
        out = out.join(written(context.repeated_numbers(c)), ["dept_key", "contract_no"], "left")
    if "identities" in needs:
        by_tin, by_name = context.identities(dealings)
        out = out.join(written(by_tin), "winner_tin", "left").join(written(by_name), "winner_key", "left")
    if "agencies" in needs:
        out = out.join(written(context.agency_direct_share(c, rules["R8"].thresholds["share"])), "dept_key", "left")
    if "places" in needs:
        out = out.join(written(context.centroids(c)), "province", "left").join(written(context.agency_distances(c)), "dept_key", "left")
    if "cells" in needs:
        out = out.join(written(context.regional_cells(c, rules["R18"].thresholds["minGapPts"])), ["project_type_name", "province"], "left")
    named = {f for r in rules.values() for f in r.fields}
    return with_fields(out, c, named) if named else out


def applicable(c: DataFrame, rules: dict[str, Rule]) -> dict[str, Rule]:
    """The rules that the table has enough rows for; one pass counts for all of them."""
    asked = {k: r for k, r in rules.items() if r.applicable}
    if not asked:
        return rules
    counts = c.agg(*[F.count_if(r.applicable(r.thresholds)).alias(k) for k, r in asked.items()]).first()
    return {k: r for k, r in rules.items() if k not in asked or counts[k] >= LEAST_ROWS}


def bit(rule_id: str) -> int:
    """The value of the rule's bit in hit_mask."""
    return 1 << (int(rule_id[1:]) - 1 + (USER_BIT if rule_id[0] == "C" else 0))


def struck(rule_id: str, mask: str = "hit_mask") -> Column:
    """Whether the rule's bit is set."""
    return F.col(mask).bitwiseAND(F.lit(bit(rule_id))) != 0


def ids_of(rules: Iterable[str] | None = None, mask: str = "hit_mask") -> Column:
    """The ids of the rules whose bits are set."""
    return F.array_compact(F.array(*[F.when(struck(k, mask), F.lit(k)) for k in (default_rules() if rules is None else rules)]))


def hit_sets(evaluated: DataFrame, *by: str) -> DataFrame:
    """Contracts and their value per set of rules that hit together (and columns `by`): some hundred rows, from which all
    counts of rules follow."""
    # The mask comes out as an aggregate: conditions on it stay above, where they'd otherwise repeat each predicate in every row.
    sets = evaluated.groupBy(*by, F.col("hit_mask").alias("_set")).agg(F.max("hit_mask").alias("hit_mask"), F.count("*").alias("n"), F.sum("contract_price_agree").alias("value"))
    return sets.drop("_set")


def hit(rule: Rule) -> Column:
    return F.coalesce(rule.predicate(rule.thresholds), F.lit(False))


def score(rules: dict[str, Rule], of: Callable[[Rule], Column]) -> Column:
    """Sum of the scored hits' weights, the heaviest of each family, 100 at most; of() tells whether a rule hit."""
    parts, families = [F.lit(0.0)], {}
    for rule in rules.values():
        if rule.scored:
            got = F.when(of(rule), F.lit(float(rule.weight))).otherwise(F.lit(0.0))
            if rule.family:
                families.setdefault(rule.family, []).append(got)
            else:
                parts.append(got)
    parts += [F.greatest(*xs, F.lit(0.0)) for xs in families.values()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.least(F.lit(100.0), total)


def _severity(rules: dict[str, Rule], of: Callable[[Rule], Column], scored: bool) -> Column:
    ranks = [F.when(of(r), F.lit(SEVERITIES.index(r.severity))).otherwise(0) for r in rules.values() if r.scored or not scored]
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(F.lit(0), F.lit(0), *ranks) + 1)


def evaluate(c: DataFrame, rules: dict[str, Rule] | None = None, check: bool = True) -> DataFrame:
    """c with hit_mask, rule_hits, risk_score, max_severity, max_severity_all and risk_band.

    Each predicate is formed once, as a bit of hit_mask, and score and severities follow from the mask; what a rule found
    is written out in rule_hits only where a query reads them. c is read once for each context, so a view of many joins is
    best written first (tables.written).
    """
    rules = configured() if rules is None else rules
    rules = applicable(c, rules) if check else rules
    of_project = {k for k, r in rules.items() if not r.custom and not r.fields and set(r.needs) <= {"projects"}}
    part = lambda named: sum((F.when(hit(rules[k]), F.lit(bit(k))).otherwise(F.lit(0)) for k in named), F.lit(0).cast("long"))
    rich = enrich(c, rules, {"_early": part(k for k in rules if k in of_project)})
    mask = F.col("_early") + part(k for k, r in rules.items() if k not in of_project and not r.custom)
    if any(r.custom for r in rules.values()):
        rich, mask = rich.withColumn("hit_mask", mask.cast("long")), F.col("hit_mask")
        for k, r in rules.items():
            if r.custom:
                mask = mask + F.when(hit(r), F.lit(bit(k))).otherwise(F.lit(0))
    flagged = rich.select(*[rich[x] for x in c.columns], mask.cast("long").alias("hit_mask"), *[r.actual(r.thresholds).alias(f"_a{k}") for k, r in rules.items()])
    of = lambda r: struck(r.id)
    kind = "array<struct<rule_id:string,severity:string,weight:double,family:string,scored:boolean,actual:string>>"
    each = [F.when(of(r), F.struct(F.lit(k).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(float(r.weight)).alias("weight"), F.lit(r.family).cast("string").alias("family"), F.lit(r.scored).alias("scored"), F.col(f"_a{k}").alias("actual"))) for k, r in rules.items()]
    hits = F.array_compact(F.array(*each)) if each else F.array().cast(kind)
    out = flagged.select(*c.columns, "hit_mask", hits.alias("rule_hits"), score(rules, of).alias("risk_score"), _severity(rules, of, True).alias("max_severity"), _severity(rules, of, False).alias("max_severity_all"))
    return out.withColumn("risk_band", band(F.col("risk_score")))


def what_if(evaluated: DataFrame, exclude: Iterable[str] = (), weights: dict[str, float] | None = None, rules: dict[str, Rule] | None = None) -> DataFrame:
    """evaluated with what_if_score: the stored hits scored again without some rules or under other weights. Where the rules
    that were evaluated are given, the mask tells their hits, and what they found needn't be written out."""
    gone, weights = list(exclude), weights or {}
    if rules is not None:
        kept = {k: replace(r, weight=float(weights.get(k, r.weight))) for k, r in rules.items() if k not in gone}
        return evaluated.withColumn("what_if_score", score(kept, lambda r: struck(r.id)))
    weight = lambda h: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for p in weights.items() for v in (p[0], float(p[1]))]), h["rule_id"]), h["weight"]) if weights else h["weight"]
    kept = F.filter("rule_hits", lambda h: h["scored"] & ~h["rule_id"].isin(*gone) if gone else h["scored"])
    scored = F.transform(kept, lambda h: F.struct(F.coalesce(h["family"], h["rule_id"]).alias("key"), weight(h).alias("w")))
    families = F.array_distinct(F.transform("_scored", lambda s: s["key"]))
    heaviest = F.transform(families, lambda k: F.array_max(F.transform(F.filter("_scored", lambda s: s["key"] == k), lambda s: s["w"])))
    return evaluated.withColumn("_scored", scored).withColumn("what_if_score", F.least(F.lit(100.0), F.aggregate(heaviest, F.lit(0.0), lambda a, x: a + x))).drop("_scored")


def summarize(evaluated: DataFrame, rules: Iterable[str] | None = None) -> DataFrame:
    """Hits and their value per rule; rules names those beside the default ones."""
    each = hit_sets(evaluated).select(F.explode(ids_of(rules)).alias("rule_id"), "n", "value")
    return each.groupBy("rule_id").agg(F.sum("n").alias("n"), F.sum("value").cast("double").alias("value"))


def bands(evaluated: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Contracts, value and mean score per band; flagged counts those with any hit, unscored ones too. rules: those evaluated,
    where their weights aren't the default ones; scores are formed once for each set of rules."""
    rules = configured() if rules is None else rules
    sets = hit_sets(evaluated).withColumn("risk_score", score(rules, lambda r: struck(r.id)))
    sets = sets.withColumn("risk_band", band(F.col("risk_score")))
    flagged = F.coalesce(F.sum(F.when(F.col("hit_mask") != 0, F.col("n"))), F.lit(0))
    return sets.groupBy("risk_band").agg(F.sum("n").alias("n"), flagged.alias("flagged"), F.sum("value").cast("double").alias("value"), F.round(F.sum(F.col("risk_score") * F.col("n")) / F.sum("n"), 4).alias("avg_score"))


def coverage(evaluated: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Hits by audit dimension and stage of procurement."""
    rules = configured() if rules is None else rules
    spark = evaluated.sparkSession
    frame = spark.createDataFrame([(k, d, r.stage) for k, r in rules.items() for d in r.dimensions], "rule_id string, dimension string, stage string")
    return summarize(evaluated).join(frame, "rule_id").groupBy("dimension", "stage").agg(F.count("*").alias("n_rules"), F.sum("n").alias("n_hits"))


def overlap(evaluated: DataFrame) -> DataFrame:
    """Pairs of rules that hit the same contracts: both, either, Jaccard and containment; pairs within a row only."""
    rows = hit_sets(evaluated).select(F.array_sort(ids_of()).alias("ids"), "n")
    two = rows.select("n", F.explode("ids").alias("rule_a"), "ids").select("n", "rule_a", F.explode("ids").alias("rule_b")).filter("rule_a <= rule_b")
    both = two.groupBy("rule_a", "rule_b").agg(F.sum("n").alias("n_both"))
    # A rule with itself is the rule alone; there are as many rows as pairs of rules.
    alone = F.when(F.col("rule_a") == F.col("rule_b"), F.col("n_both"))
    out = both.withColumn("n_a", F.max(alone).over(W.partitionBy("rule_a"))).withColumn("n_b", F.max(alone).over(W.partitionBy("rule_b"))).filter("rule_a != rule_b")
    jaccard, inside = F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")), F.col("n_both") / F.least("n_a", "n_b")
    return out.select("rule_a", "rule_b", "n_a", "n_b", "n_both", F.round(jaccard, 6).alias("jaccard"), F.round(inside, 6).alias("containment"))


def sensitivity(c: DataFrame, rule: Rule, key: str, steps: int = 12) -> DataFrame:
    """Hits of a rule for values of one threshold over its range, counted in one pass."""
    low, high, step = rule.ranges[key]
    grid = sorted({round(round((low + (high - low) * i / steps) / step) * step, 10) for i in range(steps + 1)})
    rich = enrich(c, {rule.id: rule})
    counts = rich.agg(*[F.count_if(hit(replace(rule, thresholds=rule.thresholds | {key: v}))).alias(str(i)) for i, v in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(float(v)).alias("threshold"), F.col(f"`{i}`").alias("n")) for i, v in enumerate(grid)])
    return counts.select(F.explode(rows).alias("x")).select("x.threshold", "x.n")

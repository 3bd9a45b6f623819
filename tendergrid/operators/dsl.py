"""User rules as data: conditions on named fields, compiled to a predicate that Catalyst can push down.

A rule may be kept in a registry (sources/registry.py) under an id C1, C2, ...; as_rules() makes such rules part of an
evaluation, where they count like any other.
"""

from __future__ import annotations

import json
import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import registry
from .fields import of_the_row
from .rules import SEVERITIES, USER_BIT, Rule, default_rules, hit_sets, ids_of, struck

#: Fields by kind; a rule may only name these. A field that the table lacks is null in each row.
FIELDS = {
    **dict.fromkeys((
        "contract_price_agree", "price_build", "project_money", "discount_pct", "duration_days", "announce_gap_days", "ml_pct", "project_n_contracts", "contract_day", "contractor_n_contracts", "contractor_n_agencies",
        "contractor_top_agency_share", "contractor_specific_share", "contractor_burst30", "pair_n_contracts", "pair_share_of_agency", "risk_score", "pair_n",
    ), "num"),
    **dict.fromkeys(("purchase_method_name", "method_group", "project_type_name", "work_group", "province", "geo_quality"), "cat"),
    **dict.fromkeys(("project_name", "dept_name", "dept_key"), "text"), **dict.fromkeys(("is_jv", "tin_is_masked", "weekend", "month_end"), "bool"),
    "rule_hit": "rule", "contractor_archetype": "set",
}
#: Fields with values of their own, whatever the table holds.
VOCABULARY = {"method_group": ("เฉพาะเจาะจง", "e-bidding", "คัดเลือก", "อื่น ๆ"), "geo_quality": ("ok", "shared", "none"), "contractor_archetype": ("captive", "ceiling_hug", "under_ceiling", "burst", "specific_heavy", "wide")}
MOST_SAVED = 63 - USER_BIT
OPERATORS = {
    "num": {">", ">=", "<", "<=", "==", "!=", "between"}, "cat": {"==", "!=", "in", "not_in"}, "text": {"contains", "not_contains"},
    "bool": {"is"}, "rule": {"has", "not_has"}, "set": {"has", "not_has"},
}
_COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


def _values(c: dict) -> list:
    return list(c["value"]) if isinstance(c["value"], (list, tuple)) else [c["value"]]


def _number(value: object) -> bool:
    return not isinstance(value, bool) and isinstance(value, (int, float)) and math.isfinite(value)


def validate(rule: dict | str) -> dict:
    """The rule, which may be JSON, with its weight a whole number of 1 to 40 and its severity and category filled in;
    ValueError tells what is wrong with it. Values that only the table can know are checked by unknown_values()."""
    rule = json.loads(rule) if isinstance(rule, str) else rule
    if not isinstance(rule, dict):
        raise ValueError("a rule is an object")
    conditions = rule.get("conditions") or []
    if not str(rule.get("name") or "").strip():
        raise ValueError("a rule needs a name")
    if not isinstance(conditions, list) or not 1 <= len(conditions) <= 8:
        raise ValueError("a rule has 1 to 8 conditions")
    if rule.get("match", "all") not in ("all", "any"):
        raise ValueError("match is all or any")
    for c in conditions:
        kind = FIELDS.get(c.get("field"))
        if kind is None or c.get("op") not in OPERATORS[kind]:
            raise ValueError(f"no condition {c}")
        value = c.get("value")
        if c["op"] == "between" and not (isinstance(value, (list, tuple)) and len(value) == 2 and all(map(_number, value))):
            raise ValueError("between needs two values")
        if c["op"] in ("in", "not_in") and not (isinstance(value, (list, tuple)) and value):
            raise ValueError("in needs values")
        if kind == "num" and c["op"] != "between" and not _number(value):
            raise ValueError(f"{c['field']} needs a number")
        if kind == "text" and len(str(value).strip()) < 2:
            raise ValueError("a text has two characters at least")
        known = default_rules() if kind == "rule" else VOCABULARY.get(c["field"])
        if known is not None and not set(_values(c)) <= set(known):
            raise ValueError(f"{c['field']} has no value {value!r}")
    weight = rule.get("weight", 10)
    if not _number(weight):
        raise ValueError("a weight is a number")
    severity = rule.get("severity") if rule.get("severity") in SEVERITIES[1:] else "medium"
    return rule | {"name": str(rule["name"]).strip()[:80], "weight": max(1, min(40, round(weight))), "severity": severity, "category": rule.get("category") or "competition"}


def unknown_values(c: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """(rule_id, field, value) of categories that rules name and no row of c has, from one pass over c; a field that c
    lacks has none."""
    named = sorted({(k, x["field"], str(v)) for k, r in rules.items() for x in validate(r)["conditions"] if FIELDS[x["field"]] == "cat" and x["field"] not in VOCABULARY for v in _values(x)})
    if not named:
        return c.sparkSession.createDataFrame([], "rule_id string, field string, value string")
    held = lambda f, v: F.coalesce(F.max(F.col(f).cast("string") == v), F.lit(False)) if f in c.columns else F.lit(False)
    told = c.agg(F.count("*").alias("_n"), *[held(f, v).alias(f"_{i}") for i, (_, f, v) in enumerate(named)])
    rows = F.array(*[F.struct(F.lit(k).alias("rule_id"), F.lit(f).alias("field"), F.lit(v).alias("value"), F.col(f"_{i}").alias("held")) for i, (k, f, v) in enumerate(named)])
    return told.select(F.explode(rows).alias("x")).filter("!x.held").select("x.rule_id", "x.field", "x.value")


def field(name: str) -> Column:
    own = of_the_row("geo" if name == "geo_quality" else name)
    return F.col(name) if own is None else own


def condition(c: dict) -> Column:
    """Never null. A number that is null satisfies nothing, not even !=; a category that is null satisfies != and not_in."""
    kind, op, value = FIELDS[c["field"]], c["op"], c["value"]
    if kind == "rule":
        held = F.coalesce(struck(value), F.lit(False))
        return held if op == "has" else ~held
    x = field(c["field"])
    if kind == "num":
        x = x.cast("double")
        test = x.between(*sorted(map(float, value))) if op == "between" else _COMPARE[op](x, F.lit(float(value)))
        return F.coalesce(test & ~F.isnan(x), F.lit(False))
    if kind == "cat":
        values = list(value) if op in ("in", "not_in") else [value]
        member = F.coalesce(x.isin(*values), F.lit(False))
        return member if op in ("==", "in") else ~member
    if kind == "text":
        found = F.lower(F.coalesce(x, F.lit(""))).contains(str(value).lower())
        return found if op == "contains" else ~found
    if kind == "bool":
        return F.coalesce(x, F.lit(False)) == F.lit(bool(value))
    held = F.coalesce(F.array_contains(x, value), F.lit(False))
    return held if op == "has" else ~held


def compile_rule(rule: dict) -> Column:
    parts = [condition(c) for c in validate(rule)["conditions"]]
    return reduce(operator.and_ if rule.get("match", "all") == "all" else operator.or_, parts)


def describe(rule: dict) -> str:
    joint = " and " if rule.get("match", "all") == "all" else " or "
    return joint.join(f"{c['field']} {c['op']} {c['value']}" for c in rule["conditions"])


def as_rules(saved: dict[str, dict]) -> dict[str, Rule]:
    """Saved rules as rules of an evaluation. A condition on rule_hit sees the hits of the default rules."""

    def made(rule_id: str, rule: dict) -> Rule:
        rule = validate(rule)
        named = {"geo" if c["field"] == "geo_quality" else c["field"] for c in rule["conditions"]}
        shown = [c["field"] for c in rule["conditions"][:3] if FIELDS[c["field"]] not in ("rule", "set")]
        found = lambda t: F.concat_ws(", ", *[F.concat_ws(" ", F.lit(f), field(f).cast("string")) for f in shown])
        return Rule(rule_id, rule["severity"], float(rule["weight"]), rule["category"], lambda t: compile_rule(rule), found, fields=tuple(sorted(named - {"rule_hit"})), custom=True)

    return {k: made(k, r) for k, r in saved.items()}


def saved_rules(spark: SparkSession, path: str) -> dict[str, dict]:
    """The rules of a registry by id; at most MOST_SAVED."""
    found = {k: validate(v) for k, v in registry.entries(spark, path).items()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][1:])))


def save_rule(spark: SparkSession, path: str, rule: dict | str) -> str:
    """Adds the rule to a registry under the first free id of C1, C2, ..., which is returned."""
    rule, used = validate(rule), registry.entries(spark, path)
    free = [f"C{i}" for i in range(1, MOST_SAVED + 1) if f"C{i}" not in used]
    if not free:
        raise ValueError(f"{MOST_SAVED} rules are saved already")
    registry.put(spark, path, {free[0]: json.dumps(rule, ensure_ascii=False, sort_keys=True)})
    return free[0]


def delete_rule(spark: SparkSession, path: str, rule_id: str) -> bool:
    """Whether there was such a rule; its id is free then."""
    known = rule_id in registry.entries(spark, path)
    if known:
        registry.put(spark, path, {rule_id: None})
    return known


def backtest(evaluated: DataFrame, rule: dict) -> DataFrame:
    """One row: what the rule would hit among scored contracts."""
    got = compile_rule(rule)
    hits = evaluated.withColumn("_hit", got)
    on = F.col("_hit")
    count = lambda p: F.count_if(on & p)
    return hits.agg(
        F.count("*").alias("total"), F.count_if(on).alias("hits"), F.round(F.count_if(on) / F.count("*"), 6).alias("share"), F.coalesce(F.sum(F.when(on, F.col("contract_price_agree"))).cast("double"), F.lit(0.0)).alias("value"),
        count(F.col("hit_mask") == 0).alias("unflagged"), count(F.col("risk_band").isin("critical", "high")).alias("priority"), F.count_distinct(F.when(on, F.col("dept_key"))).alias("n_agencies"), F.count_distinct(F.when(on, F.col("winner_key"))).alias("n_winners"),
    )


def backtest_overlap(evaluated: DataFrame, rule: dict, top: int = 6) -> DataFrame:
    """The rules that hit most of the same contracts, by Jaccard."""
    hits = hit_sets(evaluated.withColumn("hit", compile_rule(rule)), "hit").select("hit", F.col("n").alias("k"), ids_of().alias("ids"))
    # A row of its own counts the rule: one pass over the contracts, then a row per rule and set of rules.
    ids = F.explode(F.concat("ids", F.array(F.lit("")))).alias("rule_id")
    each = hits.select("hit", "k", ids).groupBy("rule_id").agg(F.sum("k").alias("n_other"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("k"))), F.lit(0)).alias("n_both"))
    each = each.withColumn("n", F.max(F.when(F.col("rule_id") == "", F.col("n_both"))).over(W.partitionBy(F.lit(0)))).filter("rule_id != ''")
    return each.withColumn("jaccard", F.round(F.col("n_both") / (F.col("n_other") + F.col("n") - F.col("n_both")), 6)).drop("n").orderBy(F.desc("jaccard"), "rule_id").limit(top)

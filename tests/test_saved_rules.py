"""User rules: all fields, saved rules in evaluations, registries of rules and data sets."""

import datetime

import pytest
from pyspark.sql import functions as F

from tendergrid.operators import dsl, rules
from tendergrid.operators.fields import DERIVED, lab_fields, with_fields
from tendergrid.sources import registry

SCHEMA = "project_id string, contract_no int, dept_key string, winner_key string, contract_price_agree double, price_build double, contract_date date, purchase_method_name string, province string, lat double, geo_quality string, tin_is_masked boolean"


def contracts(spark):
    day = datetime.date(2024, 1, 5)
    rows = [(f"p{i // 2 if i < 6 else i}", i, f"d{i % 3}", f"w{i % 4}", 100.0 * (i + 1), 100.0 * (i + 1) / 0.95, day + datetime.timedelta(days=3 * i), "คัดเลือก" if i % 2 else "อื่น", "north", None if i == 4 else 7.0, "shared" if i == 5 else "ok", False) for i in range(12)]
    rows += [(None, 90, None, None, None, None, None, None, None, None, None, None)] * 2
    return rows, spark.createDataFrame(rows, SCHEMA)


def rule(*conditions, **more):
    return {"name": "r", "conditions": [dict(zip(("field", "op", "value"), c)) for c in conditions]} | more


def hits(spark, c, *saved):
    custom = dsl.as_rules({f"C{i + 1}": r for i, r in enumerate(saved)})
    out = rules.evaluate(c, rules.configured(only=["R3", "R19"], custom=custom))
    assert out.columns[: len(c.columns)] == c.columns and out.count() == c.count()
    return out


def test_fields_of_a_part_are_those_of_all(spark):
    _, c = contracts(spark)
    whole = lab_fields(c)
    assert whole.count() == 14
    for name in DERIVED:
        part = with_fields(c, c, [name])
        assert part.columns == [*[x for x in part.columns if x in c.columns], name] and set(part.columns) == {*c.columns, name}
        key = lambda r: str(r)
        assert sorted(part.select("contract_no", name).collect(), key=key) == sorted(whole.select("contract_no", name).collect(), key=key), name


def test_saved_rules_score(spark):
    rows, c = contracts(spark)
    out = hits(spark, c, rule(("pair_n_contracts", ">=", 1), ("rule_hit", "has", "R3"), weight=30), rule(("discount_pct", "between", [5.5, 4.5]), weight=7.4, severity="critical"), rule(("ml_pct", ">=", 0), ("geo_quality", "==", "none"), match="any"))
    told = {r.contract_no: r for r in out.filter("project_id is not null").collect()}
    for p in rows[:12]:
        r = told[p[1]]
        want = [k for k, on in (("R3", p[1] < 6), ("R19", p[6].weekday() >= 5), ("C1", p[1] < 6), ("C2", p[1] >= 6), ("C3", p[9] is None)) if on]
        assert sorted(x.rule_id for x in r.rule_hits) == sorted(want)
        assert r.risk_score == sum({"R3": 20, "R19": 12, "C1": 30, "C2": 7, "C3": 10}[k] for k in want)
        assert ("C2" in want) == (r.max_severity == "critical")
    empty = [r for r in out.filter("project_id is null").collect()]
    assert [[x.rule_id for x in r.rule_hits] for r in empty] == [["C3"], ["C3"]]
    by = {r.rule_id: r.n for r in rules.summarize(out, ["R3", "R19", "C1", "C2", "C3"]).collect()}
    assert by["C1"] == 6 and by["C2"] == 6 and by["C3"] == 3


def test_sets_and_actual(spark):
    _, c = contracts(spark)
    out = hits(spark, c, rule(("contractor_archetype", "not_has", "captive"), ("contract_price_agree", ">", 1100)))
    (found,) = out.filter(rules.struck("C1")).collect()
    assert found.contract_no == 11 and found.rule_hits[-1].actual == "contract_price_agree 1200.0"
    again = rules.evaluate(c, rules.configured({"C1": {"enabled": False}}, only=["R3"], custom=dsl.as_rules({"C1": rule(("province", "==", "north"))})))
    assert again.filter(rules.struck("C1")).count() == 0


def test_validate_fills_in_and_refuses():
    got = dsl.validate('{"name": " n ", "weight": 99.6, "severity": "x", "conditions": [{"field": "weekend", "op": "is", "value": true}]}')
    assert got["name"] == "n" and got["weight"] == 40 and got["severity"] == "medium" and got["category"] == "competition"
    assert len(set(dsl.FIELDS)) == 33
    for bad in (rule(("method_group", "==", "x")), rule(("rule_hit", "has", "R99")), rule(("contractor_archetype", "has", "x")), rule(("contract_day", "between", [1, "x"])), rule(("contract_day", ">", float("nan"))), rule(("weekend", "is", True), weight="x"), rule(("dept_name", "contains", " a ")), "[]"):
        with pytest.raises(ValueError):
            dsl.validate(bad)


def test_unknown_values(spark):
    _, c = contracts(spark)
    asked = {"C1": rule(("province", "in", ["north", "south"]), ("method_group", "==", "อื่น ๆ")), "C2": rule(("work_group", "==", "road"))}
    assert sorted(map(tuple, dsl.unknown_values(c, asked).collect())) == [("C1", "province", "south"), ("C2", "work_group", "road")]
    assert dsl.unknown_values(c.limit(0), asked).count() == 3 and dsl.unknown_values(c, {}).count() == 0


def test_registry_of_rules(spark, tmp_path):
    path = str(tmp_path / "rules")
    assert dsl.saved_rules(spark, path) == {} and not dsl.delete_rule(spark, path, "C1")
    ids = [dsl.save_rule(spark, path, rule(("contract_day", ">", i))) for i in range(3)]
    assert ids == ["C1", "C2", "C3"] and dsl.delete_rule(spark, path, "C2") and not dsl.delete_rule(spark, path, "C2")
    assert list(dsl.saved_rules(spark, path)) == ["C1", "C3"] and dsl.save_rule(spark, path, rule(("weekend", "is", True))) == "C2"
    assert dsl.saved_rules(spark, path)["C2"]["conditions"][0]["field"] == "weekend"
    assert [r.key for r in registry.history(spark, path).collect()] == ["C1", "C2", "C3", "C2", "C2"]
    with pytest.raises(ValueError):
        dsl.save_rule(spark, path, rule(("nothing", ">", 1)))
    registry.put(spark, path, {f"C{i}": "{}" for i in range(1, dsl.MOST_SAVED + 1)})
    with pytest.raises(ValueError, match="saved already"):
        dsl.save_rule(spark, path, rule(("weekend", "is", True)))


def test_registry_of_data_sets(spark, tmp_path):
    _, c = contracts(spark)
    path = str(tmp_path / "sets")
    assert registry.read_active(spark, path, c).count() == 14
    one, two = registry.save_dataset(spark, path, c, "one"), registry.save_dataset(spark, path, c.limit(0), "two")
    registry.activate(spark, path, one)
    registry.rename_dataset(spark, path, two, "zwei")
    told = registry.list_datasets(spark, path)
    assert list(told) == [two, one] and told[two]["name"] == "zwei" and told[two]["n_records"] == 0 and told[two]["contract_date_min"] is None
    assert told[one]["n_records"] == 14 and told[one]["n_agencies"] == 3 and told[one]["geo_pct"] == 78.6 and told[one]["contract_date_max"] == "2024-02-07"
    assert registry.read_active(spark, path, c.limit(0)).agg(F.sum("contract_price_agree")).first()[0] == 7800
    registry.remove_dataset(spark, path, one)
    assert registry.active(spark, path) is None and list(registry.list_datasets(spark, path)) == [two] and not (tmp_path / "sets-data" / one).exists()
    assert registry.save_dataset(spark, path, c, "three") == "ds_3"
    with pytest.raises(ValueError):
        registry.activate(spark, path, one)

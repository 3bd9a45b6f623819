"""Registered queries of the reports and of the rule laboratory, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import band, first_group, round_kind
from ..functions.stats import auc, correlation_of_logs, spearman
from ..functions.values import EBIDDING_METHOD, SPECIFIC_METHOD
from ..operators import analytics, context, dsl, graph, lab, merge, models, patterns, reports, rules, text, unit_costs
from ..sources import scope
from ..tables import fresh, written
from .contracts import K, contracts, table, viewed
from .oracles import _BURST, _D, _DISC, _KM, _P, _RULES, _S, _V, _X, ORACLES, _band, _score, contractor_sql
from .queries import PLAIN_RULES, _scored

REPORTS: dict = {}
REPORT_SQL: dict[str, str] = {}
PLAIN = tuple(PLAIN_RULES)


def report(sql: str | None = None):
    def add(f):
        REPORTS[f.__name__] = f
        if sql:
            REPORT_SQL[f.__name__] = sql
        return f

    return add


_PRICES = f"q AS (SELECT dept_key, winner_key, CAST(round({_D.format('contract_price_agree')} / 1000) AS BIGINT) * 1000 AS p FROM k WHERE round({_D.format('contract_price_agree')} / 1000) > 0)"


def _worst() -> str:
    rank = {"low": 1, "medium": 2, "high": 3, "critical": 4}
    return f"greatest({', '.join(f'CASE WHEN {k} THEN {rank[s]} ELSE 0 END' for k, (s, weight, _) in _RULES.items() if weight)})"


_TIES = ["project_id", "contract_no", "winner_key", "contract_date"]
_PRICE = _D.format("contract_price_agree")


@report(f"""{K}, w AS (SELECT winner_key, count(*) AS n, CAST(sum(contract_price_agree) AS DOUBLE) AS value FROM k GROUP BY 1), t AS (SELECT * FROM w ORDER BY value DESC, winner_key LIMIT 20)
SELECT *, round(100 * value / sum(value) OVER (), 2) AS share_pct FROM t""")
def top_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = contracts(spark, sf_dir).groupBy("winner_key").agg(F.count("*").alias("n"), F.sum("contract_price_agree").cast("double").alias("value"))
    return reports.top_n(w, "value", 20, ["winner_key"])


@report(f"""WITH c AS ({ORACLES['contractor_profiles']}), s2 AS ({_S} SELECT winner_key, round(avg(risk_score), 4) AS avg_score FROM s GROUP BY 1)
SELECT winner_key, n, value, archetypes, avg_score, CASE WHEN archetypes = '' THEN 0 ELSE len(list_filter(string_split(archetypes, ','), lambda a: a != 'wide')) END AS n_archetypes
FROM c JOIN s2 USING (winner_key) ORDER BY n_archetypes DESC, avg_score DESC, value DESC, winner_key LIMIT 15""")
def ranked_contractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = written(_scored(spark, sf_dir).select("winner_key", "risk_score"))
    got = reports.ranked_contractors(patterns.contractors(viewed(spark, sf_dir), ceiling=50_000), scored)
    return got.select("winner_key", "n", "value", F.array_join("archetypes", ",").alias("archetypes"), "avg_score", "n_archetypes")


@report(f"""WITH c AS ({ORACLES['contractor_profiles']}) SELECT archetype, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT unnest(string_split(archetypes, ',')) AS archetype, value FROM c WHERE archetypes != '') GROUP BY 1""")
def archetype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.archetype_counts(patterns.contractors(viewed(spark, sf_dir), ceiling=50_000))


@report(f"""{K}, a AS (SELECT * FROM k ORDER BY contract_price_agree DESC, {', '.join(_TIES)} LIMIT 400), b AS (SELECT * FROM k ORDER BY price_build DESC, {', '.join(_TIES)} LIMIT 400)
SELECT count(*) AS n_both, round(count(*) / 400, 6) AS overlap FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {' AND '.join(f'a.{t} = b.{t}' for t in _TIES)})""")
def top_400_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the 400 dearest contracts are those of the highest reference prices."""
    c = written(contracts(spark, sf_dir).select(*_TIES, "contract_price_agree", "price_build"))
    first = [c.orderBy(F.desc(x), *_TIES).limit(400) for x in ("contract_price_agree", "price_build")]
    return reports.top_overlap(*first, _TIES, 400)


@report(f"""{_S}, e AS (SELECT dept_key AS source, winner_key AS target, count(*) AS n, CAST(sum(contract_price_agree) AS DOUBLE) AS value, max(risk_score) AS max_risk, count(*) FILTER (flagged) AS flagged FROM s GROUP BY 1, 2)
SELECT * FROM e WHERE n >= 20 AND value >= 500000 AND flagged > 0""")
def filtered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.edge_filter(analytics.network_edges(_scored(spark, sf_dir)), least_n=20, least_value=500_000, flagged_only=True)


@report(f"{K} SELECT province, count(*) AS n, CAST(sum(contract_price_agree) AS DOUBLE) AS value FROM k WHERE lat BETWEEN 8 AND 14 AND lon BETWEEN 98 AND 101 GROUP BY 1")
def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = reports.within(contracts(spark, sf_dir), 8, 98, 14, 101)
    return inside.groupBy("province").agg(F.count("*").alias("n"), F.sum("contract_price_agree").cast("double").alias("value"))


_PCT = "round(100 * (rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2) / count(*) OVER (PARTITION BY {0}), 1)"


@report(f"""{K}, p AS (SELECT purchase_method_name, {_PCT.format('purchase_method_name', _PRICE)} AS pct FROM k)
SELECT purchase_method_name, count(*) AS n, count(*) FILTER (pct >= 95) AS n95, count(*) FILTER (pct >= 99) AS n99, round(sum(pct), 1) AS total FROM p GROUP BY 1""")
def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir).select("purchase_method_name", F.col("contract_price_agree").cast("double").alias("price"))
    p = reports.group_percentile(c, "price", ["purchase_method_name"], "pct")
    return p.groupBy("purchase_method_name").agg(F.count("*").alias("n"), F.count_if(F.col("pct") >= 95).alias("n95"), F.count_if(F.col("pct") >= 99).alias("n99"), F.round(F.sum("pct"), 1).alias("total"))


@report(f"""{K}, g AS (SELECT project_type_name, count(*) AS c FROM k GROUP BY 1), j AS (SELECT CASE WHEN c >= 10400 THEN project_type_name ELSE 'other_small' END AS scoring_group FROM k JOIN g USING (project_type_name))
SELECT scoring_group, count(*) AS n FROM j GROUP BY 1""")
def scoring_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reports.scoring_groups(contracts(spark, sf_dir).select("project_type_name"), "project_type_name", least=10_400)
    return got.groupBy("scoring_group").agg(F.count("*").alias("n"))


@report(f"""{K}, h AS (SELECT province, CASE WHEN duration_days >= 0 THEN CAST(duration_days AS DOUBLE) END AS d FROM k), m AS (SELECT province, quantile_cont(d, 0.5) AS m FROM h GROUP BY 1)
SELECT province, count(*) AS n, count(*) FILTER (d IS NULL) AS n_missing, round(avg(coalesce(d, m)), 6) AS mean FROM h JOIN m USING (province) GROUP BY 1""")
def imputed_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir).select("province", F.when(F.col("duration_days") >= 0, F.col("duration_days")).alias("d"))
    got = reports.imputed(c, "d", ["province"], "filled")
    return got.groupBy("province").agg(F.count("*").alias("n"), F.count_if(F.col("d").isNull()).alias("n_missing"), F.round(F.avg("filled"), 6).alias("mean"))


@report(f"""{K}, b AS (SELECT CAST(least(greatest(floor((log10({_PRICE}) - 2) / (3.0 / 30)), 0), 29) AS INTEGER) AS bin FROM k WHERE contract_price_agree > 0) SELECT bin, count(*) AS n FROM b GROUP BY 1""")
def log_price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir).filter("contract_price_agree > 0").select(F.log10(F.col("contract_price_agree").cast("double")).alias("x"))
    return reports.histogram(c, "x", 2, 5, 30)


@report(f"""{K}, c AS (SELECT dept_key, project_type_name, count(*) AS n FROM k GROUP BY 1, 2) SELECT dept_key, arg_min(project_type_name, (-n, project_type_name)) AS mode FROM c GROUP BY 1""")
def agency_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.modes(contracts(spark, sf_dir), "dept_key", "project_type_name")


@report(f"{K} SELECT dept_key, count(*) AS n, round(stddev_samp({_PRICE}) / avg({_PRICE}), 6) AS cv FROM k GROUP BY 1 HAVING count(*) >= 5")
def agency_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.variation(contracts(spark, sf_dir), "dept_key", "contract_price_agree")


@report(f"""WITH h AS ({ORACLES['hhi_by_agency']}) SELECT CASE WHEN top_winner_share >= 2 THEN 'high' WHEN top_winner_share >= 1.7 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM h GROUP BY 1""")
def agency_share_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.share_bands(analytics.hhi(contracts(spark, sf_dir)), "top_winner_share", 1.7, 2).groupBy("band").agg(F.count("*").alias("n"))


_FLAGS = f"""f AS (SELECT CAST(risk_score >= 40 AS INTEGER) AS score, CAST({_PRICE} >= 40000 AS INTEGER) AS price, CAST(duration_days >= 35 AS INTEGER) AS duration FROM s),
a AS (SELECT score + price + duration AS n_agree, CASE WHEN score + price + duration != 1 THEN '' WHEN score = 1 THEN 'score' WHEN price = 1 THEN 'price' ELSE 'duration' END AS sole FROM f)"""


@report(f"{_S}, {_FLAGS} SELECT n_agree, sole, count(*) AS n FROM a GROUP BY 1, 2")
def engine_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.agreement(_scored(spark, sf_dir), {"score": F.col("risk_score") >= 40, "price": F.col("contract_price_agree") >= 40_000, "duration": F.col("duration_days") >= 35})


_PROXY = f"l AS (SELECT (R4 OR R11 OR R20) AS label, R4 AS r4, {_PRICE} AS price, {', '.join(_TIES)} FROM s)"


@report(f"""{_S}, {_PROXY}, c AS (SELECT price, count(*) FILTER (r4) AS p, count(*) FILTER (NOT r4) AS q FROM l GROUP BY 1), b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
u AS (SELECT CAST(sum(p + q) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_positive, round(sum(p * (below + q / 2)) / (CAST(sum(p) AS DOUBLE) * CAST(sum(q) AS DOUBLE)), 6) AS auc, round(sum(p) / sum(p + q), 6) AS base_rate FROM b),
t AS (SELECT r4, row_number() OVER (ORDER BY price DESC, {', '.join(_TIES)}) AS pl FROM l)
SELECT u.*, (SELECT round(count(*) FILTER (r4) / 100, 6) FROM t WHERE pl <= 100) AS precision_100, (SELECT round(count(*) FILTER (r4) / 500, 6) FROM t WHERE pl <= 500) AS precision_500 FROM u""")
def proxy_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the price ranks the contracts of projects over budget."""
    scored = _scored(spark, sf_dir).select(*_TIES, F.col("contract_price_agree").cast("double").alias("price"), rules.struck("R4").alias("label"))
    return reports.proxy_evaluation(written(scored), "label", "price", _TIES)


@report(f"""{K}, r AS (SELECT rank() OVER (ORDER BY {_PRICE}) + (count(*) OVER (PARTITION BY {_PRICE}) - 1) / 2 AS a, rank() OVER (ORDER BY duration_days) + (count(*) OVER (PARTITION BY duration_days) - 1) / 2 AS b FROM k)
SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM r""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spearman(contracts(spark, sf_dir).select(F.col("contract_price_agree").cast("double").alias("a"), "duration_days"), "a", "duration_days")


@report(f"{K} SELECT count(*) AS n, round(corr(ln({_PRICE}), ln({_D.format('project_money')})), 6) AS corr FROM k WHERE contract_price_agree > 0 AND project_money > 0")
def log_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation_of_logs(contracts(spark, sf_dir), "contract_price_agree", "project_money")


_CATEGORY = {"R1": "price", "R2": "price", "R3": "structure", "R4": "price", "R7": "contractor", "R9": "price", "R10": "structure", "R11": "data", "R12": "method", "R13": "price", "R14": "price", "R15": "contractor", "R16": "method", "R19": "data", "R20": "data", "R21": "data", "R22": "contractor", "R23": "structure"}


def _any(kind: str) -> str:
    return " OR ".join(k for k in PLAIN if _CATEGORY[k] == kind)


@report(f"{_S} " + " UNION ALL ".join(f"SELECT '{kind}' AS category, province, count(*) AS n, CAST(sum(contract_price_agree) AS DOUBLE) AS value FROM s WHERE {_any(kind)} GROUP BY province" for kind in ("price", "structure", "contractor", "data", "method")))
def hits_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.by_category(_scored(spark, sf_dir), by="province")


@report(f"{K} SELECT DISTINCT project_type_name AS value FROM k")
def type_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.vocabulary(contracts(spark, sf_dir), "project_type_name")


_LAB = f"""{K}, {_DISC}, pn AS (SELECT project_id, count(*) AS project_n_contracts FROM k GROUP BY 1), pa AS (SELECT dept_key, winner_key, count(*) AS pair_n_contracts, sum({_PRICE}) AS pv FROM k GROUP BY 1, 2),
av AS (SELECT dept_key, sum(pv) AS agv FROM pa GROUP BY 1), wi AS (SELECT winner_key, CAST(sum(pair_n_contracts) AS BIGINT) AS contractor_n_contracts, count(*) AS contractor_n_agencies, round(max(pv) / sum(pv), 3) AS top_share FROM pa GROUP BY 1),
ds AS (SELECT winner_key, round(count(*) FILTER (purchase_method_name = '{SPECIFIC_METHOD}') / count(*), 3) AS spec FROM k GROUP BY 1), bs AS (SELECT winner_key, max(c) AS burst FROM (SELECT winner_key, {_BURST.format('dept_key, winner_key')} AS c FROM k) GROUP BY 1),
lf AS (SELECT d.*, round(discount * 100, 1) AS discount_pct, project_n_contracts, pair_n_contracts, round(pv / agv, 3) AS pair_share, contractor_n_contracts, contractor_n_agencies, top_share, spec, burst
FROM d JOIN pn USING (project_id) JOIN pa USING (dept_key, winner_key) JOIN av USING (dept_key) JOIN wi USING (winner_key) JOIN ds USING (winner_key) JOIN bs USING (winner_key))"""


@report(f"""{_LAB} SELECT winner_key, count(*) AS n, round(avg(discount_pct), 4) AS discount_pct, max(project_n_contracts) AS project_n_contracts, max(pair_n_contracts) AS pair_n_contracts, max(pair_share) AS pair_share, max(contractor_n_contracts) AS contractor_n_contracts,
max(contractor_n_agencies) AS contractor_n_agencies, max(top_share) AS top_share, max(spec) AS specific_share, max(burst) AS burst30, count(*) FILTER (dayofweek(contract_date) IN (0, 6)) AS weekend, count(*) FILTER (day(contract_date) >= 25) AS month_end FROM lf GROUP BY 1""")
def lab_field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lab.lab_fields(viewed(spark, sf_dir))
    same = {"project_n_contracts": "project_n_contracts", "pair_n_contracts": "pair_n_contracts", "pair_share": "pair_share_of_agency", "contractor_n_contracts": "contractor_n_contracts", "contractor_n_agencies": "contractor_n_agencies", "top_share": "contractor_top_agency_share", "specific_share": "contractor_specific_share", "burst30": "contractor_burst30"}
    return f.groupBy("winner_key").agg(F.count("*").alias("n"), F.round(F.avg("discount_pct"), 4).alias("discount_pct"), *[F.max(v).alias(k) for k, v in same.items()], F.count_if("weekend").alias("weekend"), F.count_if("month_end").alias("month_end"))


_GROUPS = f"CASE WHEN purchase_method_name = '{SPECIFIC_METHOD}' THEN 'เฉพาะเจาะจง' WHEN purchase_method_name = '{EBIDDING_METHOD}' THEN 'e-bidding' ELSE 'อื่น ๆ' END"
#: Work groups of the view, told by its types.
TYPE_GROUPS = (("steel", "STEEL"), ("brass", "BRASS"), ("promo", "PROMO"))
_TRAITS = {
    "vb:to_100k": f"{_PRICE} < 100000", "vb:to_500k": f"{_PRICE} >= 100000 AND {_PRICE} < 500000", "near": f"{_PRICE} >= 450000 AND {_PRICE} < 500000", "d0": "discount_pct <= 0.05", "d1": "discount_pct > 0.05 AND discount_pct <= 1", "d15": "discount_pct > 15",
    "multi": "project_n_contracts > 1", "wkend": "dayofweek(contract_date) IN (0, 6)", "mend": "day(contract_date) >= 25", "gshared": "geo_quality = 'shared'", "pair": "pair_share >= 0.5 AND pair_n_contracts >= 3",
}
_LONG_TRAITS = " UNION ALL ".join(f"SELECT '{k}' AS trait, count(*) AS n FROM lf WHERE {p}" for k, p in _TRAITS.items())


@report(f"{_LAB}, {contractor_sql(500_000, 1)}, lf2 AS (SELECT *, CASE WHEN contains(project_type_name, 'STEEL') THEN 'steel' WHEN contains(project_type_name, 'BRASS') THEN 'brass' WHEN contains(project_type_name, 'PROMO') THEN 'promo' ELSE 'other' END AS work_group, winner_key % 10 = 0 AS is_jv FROM lf), tr AS ({_LONG_TRAITS} UNION ALL SELECT 'wg:' || work_group, count(*) FROM lf2 WHERE work_group != 'other' GROUP BY 1 UNION ALL SELECT 'jv', count(*) FROM lf2 WHERE is_jv UNION ALL SELECT 'ar:' || a, count(*) FROM (SELECT winner_key, unnest(string_split(archetypes, ',')) AS a FROM ca) JOIN lf USING (winner_key) WHERE a NOT IN ('', 'wide') GROUP BY 1 UNION ALL SELECT 'pt:' || project_type_name, count(*) FROM lf GROUP BY 1 UNION ALL SELECT 'mg:' || {_GROUPS}, count(*) FROM lf GROUP BY 1) SELECT * FROM tr WHERE n > 0")
def trait_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = viewed(spark, sf_dir).withColumns({"work_group": first_group(F.col("project_type_name"), TYPE_GROUPS), "is_jv": F.col("winner_key") % 10 == 0})
    t = lab.trait_items(lab.lab_fields(c))
    return t.select(F.explode("traits").alias("trait")).groupBy("trait").agg(F.count("*").alias("n"))


#: Settings and a view under which rules that rarely fire do: smaller bounds, dearer projects, winners of one agency each.
TUNED = {"R2": {"pct": 0.05}, "R9": {"sig": 4, "minValue": 10_000}, "R10": {"minTotal": 100_000}, "R12": {"ceiling": 50_000, "bandPct": 0.1}, "R16": {"bufferDays": 1}, "R17": {"maxKm": 800}, "R22": {"minContracts": 5, "minValue": 5_000_000}}


def tuned_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir).drop("project_name")
    return c.withColumns({"project_money": (F.col("project_money") * 20).cast("decimal(20,2)"), "winner_key": F.concat_ws("-", "dept_key", F.col("winner_key") % 3)})


_T = f"""{K}, k2 AS (SELECT * REPLACE (CAST(project_money * 20 AS DECIMAL(20,2)) AS project_money, dept_key || '-' || (winner_key % 3) AS winner_key) FROM k),
tp AS (SELECT project_id, sum(contract_price_agree) AS t FROM k2 GROUP BY 1), tg AS (SELECT dept_key, winner_key, contract_date, count(*) AS gn, sum(contract_price_agree) AS gt, max(contract_price_agree) AS gm FROM k2 GROUP BY 1, 2, 3),
tw AS (SELECT winner_key, count(*) AS wn, count(DISTINCT dept_key) AS wd, sum(contract_price_agree) AS wv FROM k2 GROUP BY 1),
tc AS (SELECT province, quantile_cont(lat, 0.5) AS c_lat, quantile_cont(lon, 0.5) AS c_lon FROM k2 WHERE geo_quality = 'ok' GROUP BY 1),
td AS (SELECT dept_key, quantile_cont({_KM}, 0.5) AS md FROM k2 JOIN tc USING (province) WHERE geo_quality = 'ok' GROUP BY 1),
ts AS (SELECT contract_price_agree, CAST(price_build AS DOUBLE) AS b, {_PRICE} / pow(10.0, floor(log10({_PRICE})) - 3) AS sig, CAST(price_build - t AS DOUBLE) / CAST(price_build AS DOUBLE) >= 0.05 AS R2, gn >= 2 AND gm < 500000 AND gt >= 100000 AS R10,
purchase_method_name = '{SPECIFIC_METHOD}' AND contract_price_agree >= 45000 AND contract_price_agree < 50000 AS R12,
purchase_method_name = '{EBIDDING_METHOD}' AND announce_gap_days < CASE WHEN project_money > 50000000 THEN 20 WHEN project_money > 10000000 THEN 12 WHEN project_money > 5000000 THEN 10 WHEN project_money > 500000 THEN 5 END - 1 AS R16,
geo_quality != 'shared' AND {_KM} > 800 AND coalesce(md <= 800, true) AS R17, wd = 1 AND wn >= 5 AND wv >= 5000000 AS R22
FROM k2 JOIN tp USING (project_id) JOIN tg USING (dept_key, winner_key, contract_date) JOIN tw USING (winner_key) JOIN tc USING (province) LEFT JOIN td USING (dept_key)),
tr AS (SELECT *, contract_price_agree >= 10000 AND abs(sig - round(sig)) < 1e-9 AS R9 FROM ts)"""


@report(f"{_T} " + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) AS n, CAST(sum(contract_price_agree) AS DOUBLE) AS value FROM tr WHERE {k}" for k in TUNED))
def rule_summary_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven rules that the plain view never triggers, where they do."""
    settings = {k: {"thresholds": v} for k, v in TUNED.items()}
    return rules.summarize(rules.evaluate(written(tuned_contracts(spark, sf_dir)), rules.configured(settings, only=TUNED)))


@report(f"""{K}, {_PRICES}, g AS (SELECT dept_key, p AS price, count(*) AS n, count(DISTINCT winner_key) AS n_winners FROM q GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT winner_key) >= 2)
SELECT dept_key, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n, max(n_winners) AS most_winners FROM g GROUP BY 1""")
def same_price_by_agency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one price, to the nearest thousand, that several winners share."""
    c = contracts(spark, sf_dir).withColumn("contract_price_agree", F.round(F.col("contract_price_agree").cast("double") / 1000).cast("long") * 1000)
    groups = patterns.same_price_groups(c)
    return groups.groupBy("dept_key").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n"), F.max("n_winners").alias("most_winners"))


@report(f"""{_S}, m AS (SELECT CASE WHEN {_worst()} = 0 THEN 'none' ELSE ['low', 'medium', 'high', 'critical'][{_worst()}] END AS max_severity, contract_price_agree FROM s)
SELECT max_severity, count(*) AS n, CAST(sum(contract_price_agree) AS DOUBLE) AS value FROM m GROUP BY 1""")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts by the gravest scored rule that they hit."""
    got = _scored(spark, sf_dir)
    return got.groupBy("max_severity").agg(F.count("*").alias("n"), F.sum("contract_price_agree").cast("double").alias("value"))


@report()
def mined_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traits after which contracts are dear; frequent sets have no plain SQL."""
    t = written(lab.trait_items(lab.lab_fields(viewed(spark, sf_dir))).select("traits", "project_money", "contract_price_agree"))
    return lab.mined_traits(t, F.col("project_money") >= 300_000, least_confidence=0.1, least_lift=1.1)


def _health_sql() -> str:
    from .oracles import _RULES, _score

    leave = {k: f"({_score((k,))} < 40)" for k in _RULES}
    hits = " + ".join(f"CAST({k} AS INTEGER)" for k in _RULES)
    each = " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) FILTER ({k}) AS hits, count(*) FILTER ({k} AND nh = 1) AS sole, count(*) FILTER ({k} AND risk_score >= 40 AND {leave[k]}) AS leave_one_out, coalesce(CAST(sum(contract_price_agree) FILTER ({k}) AS DOUBLE), 0.0) AS value FROM v" for k in _RULES)
    return f"{_S}, v AS MATERIALIZED (SELECT *, {hits} AS nh FROM s), e AS ({each}) SELECT *, hits = 0 AS silent FROM e"


@report(_health_sql())
def rule_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.rule_health(_scored(spark, sf_dir), rules.configured(only=PLAIN)).drop("weight")


@report(f"WITH o AS ({ORACLES['rule_overlap']}) SELECT rule_a, rule_b, jaccard FROM o WHERE jaccard >= 0.5")
def redundant_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.redundant_rules(rules.overlap(_scored(spark, sf_dir))).select("rule_a", "rule_b", "jaccard")


@report(f"""{K}, r AS (SELECT count(*) - count(DISTINCT (project_id, contract_no)) AS rep, count(DISTINCT (project_id, contract_no)) AS keys FROM k)
SELECT count(*) AS n, round(count(province) / count(*), 6) AS filled_province, round(count(project_type_name) / count(*), 6) AS filled_project_type_name, min(contract_date) AS first_date, max(contract_date) AS last_date,
count(*) FILTER (contract_price_agree < 0) AS n_negative, count(*) FILTER (contract_finish_date < contract_date) AS n_backward, any_value(keys) AS n_keys, any_value(rep) AS n_repeated FROM k, r""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quality_report(contracts(spark, sf_dir), ["province", "project_type_name"], ["project_id", "contract_no"])


@report(f"{K} SELECT project_id, contract_no, winner_key, contract_date, duration_days FROM k WHERE duration_days < 0 ORDER BY duration_days, project_id, contract_no, winner_key, contract_date LIMIT 50")
def backward_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.backward_dates(contracts(spark, sf_dir))


@report(f"""{K}, y AS (SELECT *, CAST(year(contract_date + INTERVAL 3 MONTH) AS INTEGER) AS fiscal_year FROM k), b AS (SELECT fiscal_year, dept_key, contract_date, count(*) AS c FROM y GROUP BY 1, 2, 3 HAVING count(*) >= 3),
g AS (SELECT fiscal_year, count(*) AS busy_days, max(c) AS peak FROM b GROUP BY 1)
SELECT y.fiscal_year, count(*) AS n, CAST(0 AS BIGINT) AS undated, count(announce_gap_days) AS n_gaps, quantile_cont(CAST(announce_gap_days AS DOUBLE), 0.5) AS gap_median, coalesce(any_value(busy_days), 0) AS busy_days, coalesce(any_value(peak), 0) AS peak
FROM y LEFT JOIN g ON y.fiscal_year = g.fiscal_year GROUP BY 1""")
def contract_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.contract_timing(contracts(spark, sf_dir).select("dept_key", "contract_date", "announce_gap_days"))


@report(f"""{K} SELECT province, dept_key, CAST(2 - GROUPING(province) - GROUPING(dept_key) AS INTEGER) AS depth, count(*) AS n, CAST(sum(contract_price_agree) AS DOUBLE) AS value FROM k GROUP BY ROLLUP (province, dept_key)""")
def place_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rolled_up(contracts(spark, sf_dir), "province", "dept_key")


@report(f"""{K}, o AS (SELECT dept_key, winner_key, count(*) AS n, count(*) FILTER ({_V} % 10 = 0) AS k FROM k GROUP BY 1, 2 HAVING count(*) >= 15),
t AS (SELECT *, sum(n) OVER w AS tn, sum(k) OVER w AS tk, count(*) OVER w AS subs FROM o WINDOW w AS (PARTITION BY dept_key))
SELECT dept_key, winner_key, n, round(k / n, 6) AS share, round((tk - k) / (tn - n), 6) AS sibling_share FROM t WHERE subs >= 5""")
def sibling_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sibling_shares(contracts(spark, sf_dir), "dept_key", "winner_key", F.floor("contract_price_agree") % 10 == 0)


_KIND = f"CASE WHEN {_V} % 1000 = 0 THEN '000' WHEN {_V} % 100 = 0 THEN 'x00' WHEN {_V} % 10 = 0 THEN 'xx0' ELSE 'xxx' END"


@report(f"""{K}, r AS (SELECT dept_key, purchase_method_name AS m, {_KIND} AS kind FROM k), sh AS (SELECT m, kind, count(*) / sum(count(*)) OVER (PARTITION BY m) AS p FROM r GROUP BY 1, 2), ow AS (SELECT dept_key, m, count(*) AS c FROM r GROUP BY 1, 2),
ex AS (SELECT dept_key, kind, sum(c * p) AS expected FROM ow JOIN sh USING (m) GROUP BY 1, 2), se AS (SELECT dept_key, kind, count(*) AS n FROM r GROUP BY 1, 2)
SELECT dept_key, kind, coalesce(n, 0) AS n, round(expected, 4) AS expected FROM ex LEFT JOIN se USING (dept_key, kind)""")
def rounding_against_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.peer_expectation(contracts(spark, sf_dir), "dept_key", round_kind(F.col("contract_price_agree")), ["purchase_method_name"])


@report()
def agency_discount_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agencies' discounts against the hurdle model, which is fitted."""
    return reports.agency_discounts(models.hurdle(written(contracts(spark, sf_dir))))


@report(f"""WITH a AS ({ORACLES['pair_stats']}), r AS ({ORACLES['rotation_alternation']}), p AS ({ORACLES['spread30']}), y AS ({ORACLES['same_day_bursts']})
SELECT (SELECT count(*) FILTER (mutual) FROM a) AS mutual_pairs, (SELECT count(*) FILTER (loyal) FROM a) AS loyal_pairs, (SELECT count(*) FROM r) AS turn_agencies, (SELECT count(*) FROM p) AS split_pairs, (SELECT count(*) FROM y) AS busy_days, (SELECT count(*) FROM lineitem) AS n""")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = written(contracts(spark, sf_dir))
    return reports.highlights(c, patterns.pair_patterns(c), patterns.rotation(c, least_coverage=0.005), patterns.spread_splits(c, each_below=50_000, total_at=60_000), patterns.same_day(c, least=2))


@report("""WITH w AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1500000.0 WHEN 1 THEN CAST(o_orderkey AS DOUBLE) WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 2e9 ELSE 7500.0 END AS v FROM orders)
SELECT CAST(o_orderkey % 6 AS INTEGER) AS kind, count(v) AS n, sum(v) AS total FROM w GROUP BY 1""")
def written_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as a table shows them, with units and words, read again."""
    key = F.col("o_orderkey")
    text = F.when(key % 6 == 0, "1.5 ล้านบาท").when(key % 6 == 1, F.format_number(key, 0)).when(key % 6 == 2, F.concat(key.cast("string"), F.lit(" เลขภาษี"))).when(key % 6 == 3, "2.5 แสน").when(key % 6 == 4, "2 พันล้าน").otherwise("7.5 พันบาท")
    o = table(spark, sf_dir, "orders").select((key % 6).cast("int").alias("kind"), reports.written_number(text).alias("v"))
    return o.groupBy("kind").agg(F.count("v").alias("n"), F.sum("v").alias("total"))


_LINE_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


@report(f"""WITH p AS (SELECT s_suppkey, 10 + s_suppkey % 50 / 10.0::DOUBLE AS y, 99 + s_suppkey % 30 / 10.0::DOUBLE AS x FROM supplier)
SELECT s_suppkey, round({_LINE_KM.format(a='y', b='x', c='(y + 0.5)', d='x')} + {_LINE_KM.format(a='(y + 0.5)', b='x', c='(y + 0.5)', d='(x + 0.25)')}, 3) AS km FROM p""")
def line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = 10 + F.col("s_suppkey") % 50 / 10, 99 + F.col("s_suppkey") % 30 / 10
    point = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    wkt = F.concat(F.lit("LINESTRING("), F.concat_ws(", ", point(x, y), point(x, y + 0.5), point(x + 0.25, y + 0.5)), F.lit(")"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(reports.line_km(wkt), 3).alias("km"))


@report(f"""{K}, s AS (SELECT concat_ws('|', project_id, contract_no) AS cart_key, CAST(duration_days AS DOUBLE) / 10 AS deep FROM k WHERE project_id % 5 = 0)
SELECT province, count(*) AS n, round(sum(deep), 4) AS deep FROM k JOIN s ON concat_ws('|', k.project_id, k.contract_no) = s.cart_key GROUP BY 1""")
def joined_deep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts meet scores kept elsewhere by key; contracts without a score are left out."""
    c = contracts(spark, sf_dir).select("project_id", "contract_no", "province", "duration_days")
    scores = c.filter("project_id % 5 = 0").select(reports.cart_key("project_id", "contract_no").alias("cart_key"), (F.col("duration_days") / 10).alias("deep"))
    both = c.withColumn("cart_key", reports.cart_key("project_id", "contract_no")).join(scores, "cart_key")
    return both.groupBy("province").agg(F.count("*").alias("n"), F.round(F.sum("deep"), 4).alias("deep"))


@report(f"""{K}, p AS (SELECT province, {_PCT.format('1', _PRICE)} AS a, {_PCT.format('1', 'duration_days')} AS b FROM k) SELECT province, count(*) FILTER (a >= 99) AS ge99, count(*) FILTER (a >= 95) AS ge95, count(*) FILTER (a >= 95 AND b >= 95) AS agree, count(*) FILTER (a >= 95 AND b < 95) AS only FROM p GROUP BY 1""")
def percentile_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir).select("province", F.col("contract_price_agree").cast("double").alias("price"), "duration_days")
    p = written(reports.group_percentile(reports.group_percentile(c, "price", [], "a"), "duration_days", [], "b").select("province", "a", "b"))
    counts = [reports.deep_filter(p, "a", mode, ["b"]).groupBy("province").agg(F.count("*").alias(mode)) for mode in ("ge99", "ge95", "agree", "only")]
    out = p.select("province").distinct()
    for part in counts:
        out = out.join(part, "province", "left")
    return out.na.fill(0)


@report(f"""{K}, r AS (SELECT {_PRICE} AS price, geo_quality = 'shared' AS y FROM k), c AS (SELECT price, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM r GROUP BY 1),
b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT CAST(sum(p + q) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_positive, round(sum(p * (below + q / 2)) / (CAST(sum(p) AS DOUBLE) * CAST(sum(q) AS DOUBLE)), 6) AS auc FROM b""")
def shared_point_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir).select(F.col("contract_price_agree").cast("double").alias("price"), (F.col("geo_quality") == "shared").alias("y"))
    return auc(c, "y", "price")


#: Fields of the rules that the report on readiness tries; the tax number is emptied there, so R7 can't work.
READ_BY = {"R3": ["project_id"], "R4": ["project_money", "contract_price_agree"], "R7": ["winner_tin", "winner_key"], "R11": ["duration_days"], "R14": ["price_build", "project_money"], "R19": ["contract_date"]}
_READY = {"R3": "p_n >= 2", "R4": "CAST(p_total AS DOUBLE) / CAST(project_money AS DOUBLE) > 1.0", "R7": "false", "R11": "duration_days < 0", "R14": "abs(CAST(price_build - project_money AS DOUBLE) / CAST(project_money AS DOUBLE)) <= 0.001", "R19": "dayofweek(contract_date) IN (0, 6)"}


def _ready_sql() -> str:
    first = f"k1 AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS winner_tin) FROM k), k2 AS (SELECT * FROM k1 ORDER BY {', '.join(_TIES)}, contract_price_agree LIMIT 2000)"
    p = "p AS (SELECT project_id, count(*) AS p_n, sum(contract_price_agree) AS p_total FROM k2 GROUP BY 1), x AS (SELECT * FROM k2 JOIN p USING (project_id))"
    missing = lambda fs: "concat_ws(',', " + ", ".join(f"(SELECT CASE WHEN count({f}) = 0 THEN '{f}' END FROM k1)" for f in sorted(fs)) + ")"
    rows = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, {missing(fs)} AS missing, (SELECT count(*) FILTER ({_READY[r]}) FROM x) AS n_hits" for r, fs in READ_BY.items())
    return f"{K}, {first}, {p}, r AS ({rows}) SELECT *, CASE WHEN missing != '' THEN 'no' WHEN n_hits > 0 THEN 'yes' ELSE 'maybe' END AS status FROM r"


@report(_ready_sql())
def rule_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = viewed(spark, sf_dir).withColumn("winner_tin", F.lit(None).cast("string"))
    return lab.readiness(c, READ_BY, [*_TIES, "contract_price_agree"])


@report(f"""{_S}, f AS (SELECT 'R4 ' || province AS finding, CASE WHEN count(*) >= 4500 THEN 'high' WHEN count(*) >= 4300 THEN 'mid' ELSE 'low' END AS level, CAST(sum(contract_price_agree) AS DOUBLE) AS value FROM s WHERE R4 GROUP BY province)
SELECT finding, level, value, CAST(row_number() OVER (ORDER BY CASE level WHEN 'high' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END, value DESC, finding) AS INTEGER) AS place FROM f""")
def ordered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = _scored(spark, sf_dir).filter(rules.struck("R4"))
    n = F.count("*")
    level = F.when(n >= 4500, "high").when(n >= 4300, "mid").otherwise("low")
    found = over.groupBy("province").agg(level.alias("level"), F.sum("contract_price_agree").cast("double").alias("value"))
    return lab.rank_categories(found.select(F.concat(F.lit("R4 "), F.col("province")).alias("finding"), "level", "value"))


@report(f"""{K}, e AS (SELECT 'A::' || dept_key AS source, 'C::' || winner_key AS target, CAST(sum(contract_price_agree) AS DOUBLE) AS value, count(*) AS n FROM k GROUP BY 1, 2) SELECT * FROM e ORDER BY value DESC, source, target LIMIT 50""")
def top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.edges(contracts(spark, sf_dir)).withColumn("value", F.col("value").cast("double"))
    return e.orderBy(F.desc("value"), "source", "target").limit(50).select("source", "target", "value", "n")


@report(f"""{_P}, w AS (SELECT winner_key, count(*) AS w_n, count(DISTINCT dept_key) AS w_depts, {_D.format('sum(contract_price_agree)')} AS w_value FROM k GROUP BY 1) SELECT * FROM w""")
def winner_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.winners(contracts(spark, sf_dir)).withColumn("w_value", F.col("w_value").cast("double"))


#: Rules of a user, saved and scored beside the others.
SAVED_RULES = (
    {"name": "little off, much of the agency", "severity": "high", "weight": 18, "conditions": [{"field": "discount_pct", "op": "<=", "value": 4}, {"field": "pair_share_of_agency", "op": ">=", "value": 0.001}, {"field": "method_group", "op": "!=", "value": "e-bidding"}]},
    {"name": "over budget at a weekend", "weight": 7, "conditions": [{"field": "rule_hit", "op": "has", "value": "R4"}, {"field": "weekend", "op": "is", "value": True}, {"field": "contractor_n_agencies", "op": ">", "value": 20}]},
    {"name": "shared place or loyal winner", "weight": 11, "match": "any", "conditions": [{"field": "geo_quality", "op": "==", "value": "shared"}, {"field": "contractor_top_agency_share", "op": ">=", "value": 0.1}, {"field": "work_group", "op": "==", "value": "none of this table"}]},
)
_USER_HITS = {
    "C1": f"coalesce(p_n = 1 AND price_build > 0 AND contract_price_agree > 0 AND round((1 - {_PRICE} / {_D.format('price_build')}) * 100, 1) <= 4, false) AND round(pv / agv, 3) >= 0.001 AND purchase_method_name != '{EBIDDING_METHOD}'",
    "C2": "R4 AND R19 AND winner_agencies > 20", "C3": "geo_quality = 'shared' OR round(top / own, 3) >= 0.1",
}
_USER_SCORE = _score().replace("least(100.0, ", f"least(100.0, {' + '.join(f'CASE WHEN {k} THEN {w}.0 ELSE 0.0 END' for k, w in (('C1', 18), ('C2', 7), ('C3', 11)))} + ", 1)


@report(f"""{_X}, pa AS (SELECT dept_key, winner_key, sum({_PRICE}) AS pv FROM k GROUP BY 1, 2), av AS (SELECT dept_key, sum(pv) AS agv FROM pa GROUP BY 1),
wi AS (SELECT winner_key, count(*) AS winner_agencies, max(pv) AS top, sum(pv) AS own FROM pa GROUP BY 1), u AS (SELECT h.*, {', '.join(f'({v}) AS {k}' for k, v in _USER_HITS.items())} FROM h JOIN pa USING (dept_key, winner_key) JOIN av USING (dept_key) JOIN wi USING (winner_key)),
z AS (SELECT *, {_USER_SCORE} AS risk_score, {_score()} AS before FROM u)
SELECT {_band('risk_score')} AS risk_band, count(*) AS n, count(*) FILTER (C1) AS c1, count(*) FILTER (C2) AS c2, count(*) FILTER (C3) AS c3, count(*) FILTER ({_band('risk_score')} != {_band('before')}) AS moved, round(avg(risk_score), 4) AS avg_score FROM z GROUP BY 1""")
def saved_rule_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands under saved rules beside the plain ones, with their hits and the contracts that they move to another band."""
    path = fresh(spark)
    for rule in SAVED_RULES:
        dsl.save_rule(spark, path, rule)
    plain = rules.configured(only=PLAIN)
    both = rules.configured(only=PLAIN, custom=dsl.as_rules(dsl.saved_rules(spark, path)))
    sets = rules.hit_sets(rules.evaluate(viewed(spark, sf_dir), both))
    scores = {"risk_score": rules.score(both, lambda r: rules.struck(r.id)), "before": rules.score(plain, lambda r: rules.struck(r.id))}
    sets = sets.withColumns(scores).withColumns({"risk_band": band(F.col("risk_score")), "band_before": band(F.col("before"))})
    of = lambda p: F.coalesce(F.sum(F.when(p, F.col("n"))), F.lit(0))
    own = [of(rules.struck(k)).alias(k.lower()) for k in ("C1", "C2", "C3")]
    return sets.groupBy("risk_band").agg(F.sum("n").alias("n"), *own, of(F.col("risk_band") != F.col("band_before")).alias("moved"), F.round(F.sum(F.col("risk_score") * F.col("n")) / F.sum("n"), 4).alias("avg_score"))


@report()
def unit_cost_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price per unit of what contracts buy, by the first word of its type, against a median regression on quantity."""
    c = viewed(spark, sf_dir).select("contract_price_agree", (F.col("duration_days") + 10).alias("quantity"), F.split("project_type_name", " ")[0].alias("kind"))
    _, kinds = unit_costs.unit_costs(c, "contract_price_agree", "quantity", "kind")
    return kinds.select("kind", "n", "n_high", "n_low", *[F.round(x, 4).alias(x) for x in ("median_per_unit", "effect", "elasticity", "mad_log")])


_ORDER_FIELDS = ("o_totalprice", "o_custkey", "o_orderkey")


@report(f"""WITH r AS (SELECT row_number() OVER () AS i, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in _ORDER_FIELDS)} FROM orders), l AS ({' UNION ALL '.join(f"SELECT '{f}' AS field, {f} AS v, lag({f}) OVER (ORDER BY i) AS b FROM r" for f in _ORDER_FIELDS)})
SELECT field, count(*) AS n, count(*) FILTER (v IS NULL) AS n_missing, count(*) FILTER (v > b) AS n_up, min(v) AS least, count(*) FILTER (v > b OR v IS NULL) = 0 AS falling FROM l GROUP BY 1""")
def row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which fields the rows of the order file fall, as they stand there."""
    return scope.row_order(table(spark, sf_dir, "orders"), _ORDER_FIELDS)


@report(f"""{K}, f AS (SELECT * FROM k WHERE contains(project_type_name, 'PROMO') AND contract_price_agree >= 20000)
SELECT 'contract_price_agree' AS sort_key, min({_PRICE}) AS cutoff_value, count(DISTINCT project_id) AS n_projects, count(*) AS n_contracts, count(DISTINCT project_id) IN (1000, 2000, 5000, 10000, 20000, 50000) AS looks_capped, 'PROMO' AS name_keyword, 1.0::DOUBLE AS keyword_share FROM f""")
def search_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the export of a search covers, told from the exported files alone: contracts of a word, the dearest first."""
    found = viewed(spark, sf_dir).filter(F.col("project_type_name").contains("PROMO") & (F.col("contract_price_agree") >= 20_000))
    export, path = found.select("project_id", "project_type_name", "sum_price_agree", "contract_price_agree"), fresh(spark)
    export.orderBy(F.desc("contract_price_agree")).write.option("header", True).csv(path)
    files = spark.read.schema(export.schema).option("header", True).csv(path)
    return scope.file_scope(files, ("sum_price_agree", "contract_price_agree"), "project_type_name", ("BRASS", "PROMO"))


_PART_GROUPS = (("steel", "STEEL|steel"), ("brass", "BRASS|brass"), ("promo", "PROMO"), ("economy", "ECONOMY"))
_IN = "WITH g AS (SELECT [x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches(p_type, '{p}') THEN '{k}' END" for k, p in _PART_GROUPS) + "] IF x IS NOT NULL] AS g FROM part)"


@report(f"{_IN}, u AS (SELECT row_number() OVER () AS i, g FROM g), v AS (SELECT i, unnest(g) AS x FROM u) SELECT a.x AS a, b.x AS b, count(*) AS n FROM v a JOIN v b ON a.i = b.i AND a.x < b.x GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 8")
def part_group_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.group_overlaps(table(spark, sf_dir, "part"), _PART_GROUPS, "p_type")


@report(f"{_IN} SELECT count(*) AS n, count(*) FILTER (len(g) > 0) AS matched, round(count(*) FILTER (len(g) > 0) / count(*), 6) AS coverage, round(count(*) FILTER (len(g) > 1) / count(*), 6) AS multi_share FROM g")
def part_group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.group_coverage(table(spark, sf_dir, "part"), _PART_GROUPS, "p_type")


@report(f"""{K}, g AS (SELECT dept_sub_name AS s, count(*) AS n, count(DISTINCT project_name) AS names, count(DISTINCT dept_key) AS depts, min(dept_key) AS dept, min(province) AS province FROM k GROUP BY 1)
SELECT 'customer ' || s AS place, n, names, depts, dept, province FROM g WHERE n >= 3 AND names >= 3 ORDER BY n DESC, place LIMIT 8""")
def shared_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's contracts stand at one place."""
    c = contracts(spark, sf_dir).withColumn("project_location", F.concat(F.lit("customer "), F.col("dept_sub_name").cast("string")))
    return analytics.shared_places(c)


_NAMED = "project_name || ' หมู่ที่ ' || (winner_key % 7 + 1) || ' ตำบลบาง จังหวัด' || CASE WHEN project_id % 3 = 0 THEN 'น่าน' ELSE 'ตากใบ' END"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with a village in each name, and provinces of the same script."""
    named = F.expr(_NAMED.replace("(winner_key % 7 + 1)", "CAST(winner_key % 7 + 1 AS STRING)"))
    return contracts(spark, sf_dir).withColumn("project_name", named).withColumn("province", F.when(F.col("province") == "ASIA", "น่าน").otherwise("ตาก"))


@report(f"{K} SELECT dept_key, 'หมู่ ' || (winner_key % 7 + 1) || ' ต.บาง' AS place, count(*) AS n, CAST(sum(contract_price_agree) AS DOUBLE) AS value FROM k GROUP BY 1, 2 HAVING count(*) >= 3")
def repeated_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.repeated_places(_named(spark, sf_dir))


@report(f"""{K}, p AS (SELECT dept_key, CASE WHEN province = 'ASIA' THEN 'น่าน' ELSE 'ตาก' END AS province, CASE WHEN project_id % 3 = 0 THEN 'น่าน' ELSE 'ตากใบ' END AS said_province FROM k)
SELECT dept_key, province, said_province, count(*) AS n FROM p WHERE NOT starts_with(said_province, province) GROUP BY 1, 2, 3""")
def province_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.province_mismatch(_named(spark, sf_dir)).groupBy("dept_key", "province", "said_province").agg(F.count("*").alias("n"))


_CHANGED = " UNION ALL ".join(f"SELECT '{f}' AS field, o_orderkey, CAST({b} AS VARCHAR) AS before, CAST({a} AS VARCHAR) AS after FROM j WHERE {a} IS DISTINCT FROM {b}" for f, b, a in (("o_orderstatus", "bs", "st"), ("o_totalprice", "bp", "tp")))


@report(f"""WITH j AS (SELECT o_orderkey, o_orderstatus AS bs, CAST(o_totalprice AS DECIMAL(18,2)) AS bp, CASE WHEN o_orderkey % 4 = 0 THEN 'Z' ELSE o_orderstatus END AS st,
CASE WHEN o_orderkey % 5 = 0 THEN CAST(1 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS tp FROM orders WHERE o_orderkey % 3 != 0 AND o_orderkey % 2 = 0), x AS ({_CHANGED}),
r AS (SELECT *, count(*) OVER (PARTITION BY field) AS n, row_number() OVER (PARTITION BY field ORDER BY o_orderkey) AS nth FROM x) SELECT * FROM r WHERE nth <= 5""")
def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upsert of two in three orders by every second one changes: a count and five examples a field."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    base, key = o.filter("o_orderkey % 3 != 0"), ("o_orderkey",)
    price = F.when(F.col("o_orderkey") % 5 == 0, F.lit(1).cast("decimal(18,2)")).otherwise(F.col("o_totalprice"))
    new = o.filter("o_orderkey % 2 = 0").withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 4 == 0, "Z").otherwise(""), "o_totalprice": price})
    return merge.change_examples(merge.changes(base, merge.upsert(base, new, key), key), key)

"""Equivalent SQL of the registered queries, for DuckDB over the same tables.

Queries of seeded or iterative models (clusters, forest, hurdle, PageRank, FP-growth) and of Beta tails have none.
"""

from __future__ import annotations

from ..functions.values import EBIDDING_METHOD, SPECIFIC_METHOD
from .contracts import K

ORACLES: dict[str, str] = {}

_D = "CAST({} AS DOUBLE)"
_SIG = "(CAST(contract_price_agree AS DOUBLE) / pow(10.0, floor(log10(CAST(contract_price_agree AS DOUBLE))) - 1))"
_P = f"""{K}, p AS (SELECT project_id, count(*) AS p_n, sum(contract_price_agree) AS p_sum, count(*) FILTER (contract_price_agree IS NULL) AS p_missing,
CASE WHEN count(*) FILTER (contract_price_agree IS NULL) = 0 AND sum(contract_price_agree) > 0 THEN sum(contract_price_agree) END AS p_total FROM k GROUP BY 1)"""
_G = """g AS (SELECT dept_key, winner_key, contract_date, count(*) AS g_n, count(contract_price_agree) AS g_priced, sum(contract_price_agree) AS g_total, max(contract_price_agree) AS g_max,
count(DISTINCT project_id) AS g_projects FROM k WHERE contract_date IS NOT NULL GROUP BY 1, 2, 3)"""
_X = f"""{_P}, {_G}, pr AS (SELECT dept_key, winner_key, count(*) AS pair_n FROM k GROUP BY 1, 2),
w AS (SELECT winner_key, count(*) AS w_n, count(DISTINCT dept_key) AS w_depts, sum(contract_price_agree) AS w_value FROM k GROUP BY 1),
no AS (SELECT dept_key, contract_no, count(*) AS no_n FROM k GROUP BY 1, 2), tn AS (SELECT winner_tin, count(DISTINCT winner_key) AS tin_names FROM k GROUP BY 1),
nt AS (SELECT winner_key, count(DISTINCT winner_tin) AS name_tins FROM k GROUP BY 1),
x AS (SELECT k.*, p_n, p_total, g_n, g_priced, g_total, g_max, g_projects, pair_n, w_n, w_depts, w_value, no_n, tin_names, name_tins,
CAST(project_money AS DOUBLE) AS m, CAST(price_build AS DOUBLE) AS b, CAST(sum_price_agree AS DOUBLE) AS sp, CAST(p_total AS DOUBLE) AS t
FROM k JOIN p USING (project_id) LEFT JOIN g USING (dept_key, winner_key, contract_date) JOIN pr USING (dept_key, winner_key) JOIN w USING (winner_key)
JOIN no USING (dept_key, contract_no) JOIN tn USING (winner_tin) JOIN nt USING (winner_key)),
n AS (SELECT count(*) FILTER (contract_price_agree < 500000) AS n10, count(*) FILTER (purchase_method_name = '{SPECIFIC_METHOD}' AND contract_price_agree < 500000) AS n12,
count(*) FILTER (purchase_method_name = '{EBIDDING_METHOD}' AND project_money > 500000 AND announce_gap_days IS NOT NULL) AS n16 FROM k),
h AS (SELECT x.*,
coalesce(CAST(project_money - p_total AS DOUBLE) / m >= 0.3, false) AS R1, coalesce(CAST(price_build - p_total AS DOUBLE) / b >= 0.3, false) AS R2, p_n >= 2 AS R3, coalesce(t / m > 1.0, false) AS R4,
tin_names >= 2 OR name_tins >= 2 AS R7, contract_price_agree >= 100000 AND abs({_SIG} - round({_SIG})) < 1e-9 AS R9, n10 >= 20 AND coalesce(g_n >= 2 AND g_priced = g_n AND g_max < 500000 AND g_total >= 400000, false) AS R10, coalesce(duration_days < 0, false) AS R11,
n12 >= 20 AND coalesce(purchase_method_name = '{SPECIFIC_METHOD}' AND contract_price_agree >= 450000 AND contract_price_agree < 500000, false) AS R12,
coalesce(t / b >= 1 - 1e-9, false) AS R13, coalesce(abs(CAST(price_build - project_money AS DOUBLE) / m) <= 0.001, false) AS R14, pair_n >= 5 AS R15,
n16 >= 20 AND coalesce(purchase_method_name = '{EBIDDING_METHOD}' AND announce_gap_days < CASE WHEN project_money > 50000000 THEN 20 WHEN project_money > 10000000 THEN 12 WHEN project_money > 5000000 THEN 10 WHEN project_money > 500000 THEN 5 END, false) AS R16,
dayofweek(contract_date) IN (0, 6) AS R19, no_n >= 2 AS R20, coalesce(abs(CAST(sum_price_agree - p_total AS DOUBLE) / sp) > 0.01, false) AS R21,
w_depts = 1 AND w_n >= 5 AND w_value >= 5000000 AS R22, coalesce(g_projects >= 2, false) AS R23 FROM x, n)"""
_RULES = {"R1": ("medium", 15, "discount"), "R2": ("medium", 15, "discount"), "R3": ("high", 20, None), "R4": ("critical", 30, None), "R7": ("high", 25, None), "R9": ("low", 5, None), "R10": ("critical", 25, "split"), "R11": ("high", 0, None),
          "R12": ("high", 20, None), "R13": ("medium", 15, "exact"), "R14": ("medium", 10, None), "R15": ("medium", 15, "pair"), "R16": ("high", 20, None), "R19": ("medium", 12, None), "R20": ("high", 0, None), "R21": ("medium", 0, None),
          "R22": ("medium", 12, "pair"), "R23": ("medium", 12, "split")}


def _score(without: tuple[str, ...] = ()) -> str:
    parts, families = [], {}
    for k, (_, weight, family) in _RULES.items():
        if k not in without and weight:
            case = f"CASE WHEN {k} THEN {weight}.0 ELSE 0.0 END"
            families.setdefault(family or k, []).append(case)
    for cases in families.values():
        parts.append(f"greatest({', '.join(cases)}, 0.0)")
    return f"CAST(least(100.0, {' + '.join(parts)}) AS DOUBLE)"


def _band(score: str) -> str:
    return f"CASE WHEN {score} >= 60 THEN 'critical' WHEN {score} >= 40 THEN 'high' WHEN {score} >= 20 THEN 'medium' WHEN {score} >= 0.0001 THEN 'low' ELSE 'none' END"


_S = f"{_X}, s AS (SELECT *, {_score()} AS risk_score, {' OR '.join(_RULES)} AS flagged FROM h)"
_LONG = " UNION ALL ".join(f"SELECT '{k}' AS rule_id, contract_price_agree, row_number() OVER () AS r FROM s WHERE {k}" for k in _RULES)

ORACLES["risk_score_bands"] = f"""{_S} SELECT {_band('risk_score')} AS risk_band, count(*) AS n, count(*) FILTER (flagged) AS flagged,
CAST(sum(contract_price_agree) AS DOUBLE) AS value, round(avg(risk_score), 4) AS avg_score FROM s GROUP BY 1"""
ORACLES["rule_summary"] = f"{_S} SELECT rule_id, count(*) AS n, CAST(sum(contract_price_agree) AS DOUBLE) AS value FROM ({_LONG}) GROUP BY 1"
_FRAME = {"R1": ("economy", "award"), "R2": ("economy integrity", "award"), "R3": ("integrity efficiency", "plan"), "R4": ("economy", "award"), "R7": ("integrity", "award"), "R9": ("economy integrity", "award"), "R10": ("integrity economy", "plan"), "R11": ("integrity", "award"),
          "R12": ("integrity economy", "plan"), "R13": ("integrity economy", "award"), "R14": ("economy integrity", "plan"), "R15": ("integrity economy", "portfolio"), "R16": ("efficiency integrity", "award"), "R19": ("integrity", "award"),
          "R20": ("integrity", "award"), "R21": ("economy integrity", "award"), "R22": ("efficiency integrity", "portfolio"), "R23": ("integrity economy", "plan")}
_FRAMES = ", ".join(f"('{k}', '{d}', '{stage}')" for k, (dims, stage) in _FRAME.items() for d in dims.split())
ORACLES["rule_coverage"] = f"""{_S}, c AS (SELECT rule_id, count(*) AS n FROM ({_LONG}) GROUP BY 1), f(rule_id, dimension, stage) AS (VALUES {_FRAMES})
SELECT dimension, stage, count(*) AS n_rules, CAST(sum(n) AS BIGINT) AS n_hits FROM c JOIN f USING (rule_id) GROUP BY 1, 2"""
_PAIRS = " UNION ALL ".join(f"SELECT '{min(a, b)}' AS rule_a, '{max(a, b)}' AS rule_b, count(*) FILTER ({min(a, b)}) AS n_a, count(*) FILTER ({max(a, b)}) AS n_b, count(*) FILTER ({a} AND {b}) AS n_both FROM s" for i, a in enumerate(_RULES) for b in list(_RULES)[:i])
ORACLES["rule_overlap"] = f"""{_S.replace('s AS (', 's AS MATERIALIZED (')} SELECT rule_a, rule_b, n_a, n_b, n_both, round(n_both / CAST(n_a + n_b - n_both AS DOUBLE), 6) AS jaccard, round(n_both / CAST(least(n_a, n_b) AS DOUBLE), 6) AS containment
FROM ({_PAIRS}) WHERE n_both > 0"""
ORACLES["what_if_without_r3"] = f"{_X}, s AS (SELECT {_score(('R3',))} AS w FROM h) SELECT {_band('w')} AS band, count(*) AS n, round(sum(w), 2) AS score FROM s GROUP BY 1"
_GRID = sorted({round(round((0.05 + 0.85 * i / 12) / 0.05) * 0.05, 10) for i in range(13)})
ORACLES["sensitivity_r1"] = f"""{_P}, d AS (SELECT CAST(project_money - p_total AS DOUBLE) / CAST(project_money AS DOUBLE) AS r FROM k JOIN p USING (project_id))
SELECT CAST(v AS DOUBLE) AS threshold, count(*) FILTER (r >= CAST(v AS DOUBLE)) AS n FROM d, (VALUES {', '.join(f'({v}::DOUBLE)' for v in _GRID)}) g(v) GROUP BY 1"""
ORACLES["project_totals"] = f"{_P} SELECT project_id, p_n, {_D.format('p_sum')} AS p_sum, p_missing, {_D.format('p_total')} AS p_total FROM p"
ORACLES["over_budget_projects"] = f"""{_P}, q AS (SELECT project_id, max(project_money) AS money FROM k GROUP BY 1)
SELECT project_id, p_n, round({_D.format('p_total')} / {_D.format('money')}, 6) AS ratio FROM p JOIN q USING (project_id) WHERE {_D.format('p_total')} / {_D.format('money')} > 1.0"""
ORACLES["same_day_split"] = f"{K}, {_G} SELECT dept_key, winner_key, contract_date, g_n, g_priced, {_D.format('g_total')} AS g_total, {_D.format('g_max')} AS g_max, g_projects FROM g WHERE g_n >= 2 OR g_projects >= 2"
ORACLES["pair_stats"] = f"""{K}, o AS (SELECT dept_key, winner_key, count(*) AS n, sum(contract_price_agree) AS value, min(contract_date) AS f, max(contract_date) AS l, count(*) FILTER (purchase_method_name = '{SPECIFIC_METHOD}') AS s FROM k GROUP BY 1, 2),
t AS (SELECT *, CAST(value AS DOUBLE) / CAST(sum(value) OVER (PARTITION BY dept_key) AS DOUBLE) AS a, CAST(value AS DOUBLE) / CAST(sum(value) OVER (PARTITION BY winner_key) AS DOUBLE) AS b FROM o)
SELECT dept_key, winner_key, n, {_D.format('value')} AS value, round(a, 6) AS share_of_agency, round(b, 6) AS share_of_winner, CAST(date_diff('day', f, l) AS INTEGER) AS span_days, round(s / n, 6) AS specific_share, a >= 0.5 AND b >= 0.5 AS mutual, n >= 4 AS loyal FROM t WHERE n >= 3"""
_BURST = "count(*) OVER (PARTITION BY {} ORDER BY contract_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)"
ORACLES["burst30"] = f"{K} SELECT dept_key, winner_key, max(c) AS burst, count(*) AS n_contracts FROM (SELECT *, {_BURST.format('dept_key, winner_key')} AS c FROM k) GROUP BY 1, 2"
ORACLES["spread30"] = f"""{K}, s AS (SELECT *, sum(contract_price_agree) OVER w AS total, count(*) OVER w AS c FROM k WHERE contract_price_agree > 0 AND contract_price_agree < 50000
WINDOW w AS (PARTITION BY dept_key, winner_key ORDER BY contract_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW))
SELECT dept_key, winner_key, {_D.format('max(total) FILTER (c >= 2)')} AS max_total, max(c) AS max_n, count(DISTINCT contract_date) AS n_days FROM s GROUP BY 1, 2
HAVING max(total) FILTER (c >= 2) >= 60000 AND count(DISTINCT contract_date) >= 2"""
ORACLES["rotation_alternation"] = f"""{K}, o AS (SELECT dept_key, winner_key, count(*) AS n FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY dept_key ORDER BY n DESC, winner_key) AS rk, sum(n) OVER (PARTITION BY dept_key) AS dept_n FROM o),
t AS (SELECT k.*, r.dept_n, lag(k.winner_key) OVER (PARTITION BY k.dept_key ORDER BY contract_date, project_id, contract_no, k.winner_key, contract_price_agree) AS bef FROM k JOIN r ON k.dept_key = r.dept_key AND k.winner_key = r.winner_key WHERE rk <= 3 AND dept_n >= 6),
u AS (SELECT dept_key, count(*) AS n, CAST(first(dept_n) AS BIGINT) AS dept_n, count(*) FILTER (bef != winner_key) AS switches FROM t GROUP BY 1)
SELECT dept_key, n, dept_n, switches, round(n / dept_n, 6) AS coverage, round(switches / (n - 1), 6) AS switch_share FROM u WHERE n >= 6 AND round(n / dept_n, 6) >= 0.005 AND round(switches / (n - 1), 6) >= 0.6"""
ORACLES["monthly_trend"] = f"""{K}, m AS (SELECT strftime(contract_date, '%Y-%m') AS month, count(*) AS n, CAST(sum(contract_price_agree) AS DOUBLE) AS value FROM k GROUP BY 1)
SELECT month, n, value, round(n / avg(n) OVER (), 6) AS vs_mean FROM m"""
ORACLES["weekday_profile"] = f"{K}, d AS (SELECT CAST(dayofweek(contract_date) AS INTEGER) AS weekday, count(*) AS n, count(*) FILTER (day(contract_date) >= 25) AS n_month_end FROM k GROUP BY 1) SELECT *, round(n / sum(n) OVER (), 6) AS share FROM d"
ORACLES["same_day_bursts"] = f"{K} SELECT dept_key, contract_date, count(*) AS n, count(DISTINCT winner_key) AS n_winners, CAST(sum(contract_price_agree) AS DOUBLE) AS value FROM k GROUP BY 1, 2 HAVING count(*) >= 2"
ORACLES["round_prices"] = f"""{K}, r AS (SELECT count(*) FILTER (contract_price_agree >= 45000 AND contract_price_agree < 50000) AS below, count(*) FILTER (contract_price_agree >= 50000 AND contract_price_agree < 55000) AS above,
round(count(*) FILTER (contract_price_agree % 10000 = 0) / count(*), 6) AS round_10k, round(count(*) FILTER (contract_price_agree % 100000 = 0) / count(*), 6) AS round_100k FROM k WHERE contract_price_agree > 0) SELECT *, round(below / above, 6) AS ratio FROM r"""
ORACLES["same_price_groups"] = f"{K} SELECT dept_key, {_D.format('contract_price_agree')} AS contract_price_agree, count(*) AS n, count(DISTINCT winner_key) AS n_winners FROM k WHERE contract_price_agree > 0 GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT winner_key) >= 2"
_DISC = f"d AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY project_id) = 1 AND price_build > 0 AND contract_price_agree > 0 THEN 1 - {_D.format('contract_price_agree')} / {_D.format('price_build')} END AS discount FROM k)"
ORACLES["method_price_profile"] = f"""{K}, {_DISC} SELECT purchase_method_name, count(*) AS n, round(quantile_cont(discount, 0.5), 3) AS median_discount, round(count(*) FILTER (discount <= 0.0005) / count(*), 6) AS zero_share
FROM d WHERE discount IS NOT NULL GROUP BY 1 HAVING count(*) >= 20"""
ORACLES["discount_bins"] = f"""{K}, {_DISC}, v(bin, lo, hi) AS (VALUES ('none', -1e9, 0.0005), ('to_1', 0.0005, 0.01), ('to_5', 0.01, 0.05), ('to_15', 0.05, 0.15), ('to_30', 0.15, 0.3), ('over_30', 0.3, 1e9))
SELECT bin, count(*) FILTER (discount > CAST(lo AS DOUBLE) AND discount <= CAST(hi AS DOUBLE)) AS n, round(count(*) FILTER (discount > CAST(lo AS DOUBLE) AND discount <= CAST(hi AS DOUBLE)) / count(*), 6) AS share FROM d, v WHERE discount IS NOT NULL GROUP BY 1"""


def contractor_sql(ceiling: int, least: int = 3) -> str:
    """Winners' behaviour (CTE f) with their archetypes."""
    return f"""o AS (SELECT winner_key, count(*) AS n, CAST(sum(contract_price_agree) AS DOUBLE) AS value, count(*) FILTER (purchase_method_name = '{SPECIFIC_METHOD}') AS sp, round(quantile_cont(discount, 0.5), 6) AS median_discount, bool_or(tin_is_masked) AS masked,
count(*) FILTER (purchase_method_name != '{SPECIFIC_METHOD}' AND discount IS NOT NULL) AS n_competed, count(*) FILTER (purchase_method_name != '{SPECIFIC_METHOD}' AND discount <= 0.005) AS hug, count(discount) AS n_discounts, count(*) FILTER (discount <= 0.005) AS hug_all,
count(*) FILTER (contract_price_agree >= {ceiling} * 0.9 AND contract_price_agree < {ceiling}) AS near, min(contract_date) AS first_date, max(contract_date) AS last_date FROM d GROUP BY 1 HAVING count(*) >= {least}),
t AS (SELECT winner_key, CAST(max(v) AS DOUBLE) AS top_value, arg_min(dept_key, (-v, dept_key)) AS top_agency, count(*) AS n_agencies FROM (SELECT winner_key, dept_key, sum(contract_price_agree) AS v FROM k GROUP BY 1, 2) GROUP BY 1),
bu AS (SELECT winner_key, max(c) AS burst30 FROM (SELECT winner_key, {_BURST.format('winner_key, dept_key')} AS c FROM k) GROUP BY 1),
f AS (SELECT winner_key, n, value, n_agencies, top_agency, round(top_value / value, 6) AS top_agency_share, round(sp / n, 6) AS specific_share, median_discount, n_competed, CASE WHEN n_competed > 0 THEN round(hug / n_competed, 6) END AS ceiling_hug,
n_discounts, CASE WHEN n_discounts > 0 THEN round(hug_all / n_discounts, 6) END AS ceiling_hug_all, masked, round(near / n, 6) AS near_ceiling, burst30, first_date, last_date FROM o JOIN t USING (winner_key) JOIN bu USING (winner_key)),
ca AS (SELECT *, concat_ws(',', CASE WHEN n >= 8 AND top_agency_share >= 0.8 THEN 'captive' END, CASE WHEN n_competed >= 3 AND ceiling_hug >= 0.5 THEN 'ceiling_hug' END, CASE WHEN n >= 3 AND near_ceiling >= 0.4 THEN 'under_ceiling' END,
CASE WHEN burst30 >= 5 THEN 'burst' END, CASE WHEN n >= 5 AND specific_share >= 0.9 THEN 'specific_heavy' END, CASE WHEN n_agencies >= 8 THEN 'wide' END) AS archetypes FROM f)"""


ORACLES["contractor_profiles"] = f"{K}, {_DISC}, {contractor_sql(50_000)} SELECT * FROM ca"
_HHI = f"""o AS (SELECT dept_key, winner_key, sum(contract_price_agree) AS v, count(*) AS c FROM k WHERE contract_price_agree > 0 GROUP BY 1, 2),
t AS (SELECT dept_key, sum(v) AS total, CAST(sum(c) AS BIGINT) AS n_contracts, count(*) AS n_winners FROM o GROUP BY 1 HAVING sum(c) >= 5),
hh AS (SELECT dept_key, n_contracts, n_winners, round(sum(pow({_D.format('v')} / {_D.format('total')} * 100, 2)), 4) AS hhi, round(max({_D.format('v')} / {_D.format('total')} * 100), 4) AS top_winner_share FROM o JOIN t USING (dept_key) GROUP BY 1, 2, 3)"""
ORACLES["hhi_by_agency"] = f"{K}, {_HHI} SELECT * FROM hh"
ORACLES["agency_profiles"] = f"""{K}, {_HHI}, a AS (SELECT dept_key, count(*) AS n_contracts, count(DISTINCT winner_key) AS n_winners, round(count(*) FILTER (purchase_method_name = '{SPECIFIC_METHOD}') / count(*), 6) AS specific_share,
round(stddev_samp({_D.format('contract_price_agree')}) / avg({_D.format('contract_price_agree')}), 6) AS cv FROM k GROUP BY 1) SELECT a.*, hhi, top_winner_share FROM a LEFT JOIN hh USING (dept_key)"""
ORACLES["price_outliers"] = f"""{K}, q AS (SELECT purchase_method_name, quantile_cont({_D.format('contract_price_agree')}, [0.25, 0.5, 0.75]) AS q FROM k GROUP BY 1 HAVING count(*) >= 30)
SELECT project_id, contract_no, winner_key, {_D.format('contract_price_agree')} AS price, round({_D.format('contract_price_agree')} / q[2], 4) AS times_median FROM k JOIN q USING (purchase_method_name) WHERE {_D.format('contract_price_agree')} > q[3] + 0.5 * (q[3] - q[1])"""
ORACLES["duration_outliers"] = f"""{K}, d AS (SELECT * FROM k WHERE duration_days >= 0), q AS (SELECT province, quantile_cont(CAST(duration_days AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM d GROUP BY 1 HAVING count(*) >= 30)
SELECT province, count(*) AS n, max(duration_days) AS longest FROM d JOIN q USING (province) WHERE duration_days > q[3] + 0.3 * (q[3] - q[1]) GROUP BY 1"""
ORACLES["threshold_cliff"] = f"""{K}, t AS (SELECT CAST(floor(({_D.format('contract_price_agree')} - 50000) / 5000) AS BIGINT) AS bin FROM k WHERE contract_price_agree > 0)
SELECT bin, count(*) AS n, CASE WHEN bin < 0 THEN -1 ELSE 1 END AS side FROM t WHERE bin >= -10 AND bin < 10 GROUP BY 1"""
_R = f"({_D.format('contract_price_agree')} / {_D.format('price_build')})"
ORACLES["price_ratio_histogram"] = f"{K} SELECT CAST(floor(round({_R}, 9) * 20) AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (abs({_R} - 1) < 1e-6) AS n_exact FROM k WHERE price_build > 0 GROUP BY 1"
ORACLES["fiscal_quarters"] = f"""{K} SELECT CAST(year(contract_date + INTERVAL 3 MONTH) AS INTEGER) AS fiscal_year, CAST(quarter(contract_date + INTERVAL 3 MONTH) AS INTEGER) AS fiscal_quarter, count(*) AS n, CAST(sum(contract_price_agree) AS DOUBLE) AS value FROM k GROUP BY 1, 2"""
ORACLES["province_months"] = f"""{K} SELECT strftime(contract_date, '%Y-%m') AS month, count(*) FILTER (province = 'AFRICA') AS "AFRICA", count(*) FILTER (province = 'ASIA') AS "ASIA", count(*) FILTER (province = 'EUROPE') AS "EUROPE" FROM k GROUP BY 1"""
ORACLES["repeat_winners"] = f"{K} SELECT winner_key, count(DISTINCT dept_key) AS n_agencies, count(*) AS n_contracts, CAST(sum(contract_price_agree) AS DOUBLE) AS total_value FROM k GROUP BY 1 HAVING count(DISTINCT dept_key) >= 3"
ORACLES["new_winner_share"] = f"""{K}, f AS (SELECT winner_key, strftime(min(contract_date), '%Y-%m') AS fm FROM k GROUP BY 1), m AS (SELECT DISTINCT winner_key, strftime(contract_date, '%Y-%m') AS month FROM k)
SELECT month, count(*) AS n_winners, round(count(*) FILTER (month = fm) / count(*), 6) AS new_share FROM m JOIN f USING (winner_key) GROUP BY 1"""
ORACLES["stacked_points"] = f"""{K} SELECT CAST(floor(lat / 0.5 + 1e-9) AS BIGINT) AS cell_lat, CAST(floor(lon / 0.5 + 1e-9) AS BIGINT) AS cell_lon, count(*) AS n, count(DISTINCT (lat, lon)) AS points,
CASE WHEN count(DISTINCT (lat, lon)) = 1 THEN 'exact' ELSE 'cluster' END AS kind FROM k GROUP BY 1, 2 HAVING count(*) >= 3"""
ORACLES["network_edges"] = f"{_S} SELECT dept_key AS source, winner_key AS target, count(*) AS n, CAST(sum(contract_price_agree) AS DOUBLE) AS value, max(risk_score) AS max_risk, count(*) FILTER (flagged) AS flagged FROM s GROUP BY 1, 2"
_ORDER = "contract_price_agree DESC, project_id, contract_no, winner_key, contract_date"
_E = f"(risk_score * {_D.format('contract_price_agree')})"
_MODES = " UNION ALL ".join(f"SELECT '{m}' AS mode, {_E} AS e, row_number() OVER (ORDER BY {key} DESC, {_ORDER}) AS rk FROM s WHERE risk_score > 0" for m, key in (("exposure", _E), ("score", "risk_score"), ("value", _D.format("contract_price_agree"))))
ORACLES["queue_coverage"] = f"""{_S}, q AS ({_MODES}), tot AS (SELECT sum({_E}) AS total FROM s)
SELECT mode, z AS size, round(sum(e) FILTER (rk <= z) / any_value(total), 6) AS covered FROM q, tot, (VALUES (10), (50), (100), (500)) v(z) GROUP BY 1, 2"""
ORACLES["benford_first_digit"] = f"""{K}, d AS (SELECT dept_key, CAST(substr(CAST(CAST(floor(contract_price_agree) AS BIGINT) AS VARCHAR), 1, 1) AS INTEGER) AS digit, count(*) AS n FROM k WHERE contract_price_agree >= 1 GROUP BY 1, 2)
SELECT dept_key, digit, n, round(sum(n) OVER (PARTITION BY dept_key) * log10(1 + 1 / digit), 4) AS expected FROM d"""
_V = "CAST(floor(contract_price_agree) AS BIGINT)"
ORACLES["round_share"] = f"""{K}, d AS (SELECT dept_key, CASE WHEN {_V} % 1000 = 0 THEN '000' WHEN {_V} % 100 = 0 THEN 'x00' WHEN {_V} % 10 = 0 THEN 'xx0' ELSE 'xxx' END AS kind, count(*) AS n FROM k WHERE contract_price_agree > 0 GROUP BY 1, 2)
SELECT *, round(n / sum(n) OVER (PARTITION BY dept_key), 6) AS share FROM d"""
ORACLES["table_scope"] = f"""{K} SELECT count(*) AS n, count(DISTINCT project_id) AS n_projects, count(DISTINCT dept_key) AS n_agencies, count(DISTINCT winner_key) AS n_winners, min(contract_date) AS first_date, max(contract_date) AS last_date,
CAST(sum(contract_price_agree) AS DOUBLE) AS value, count(*) FILTER (contract_price_agree IS NULL) AS n_unpriced, count(*) FILTER (duration_days < 0) AS n_backward FROM k"""
_ITEMS = {"specific": f"purchase_method_name = '{SPECIFIC_METHOD}'", "weekend": "dayofweek(contract_date) IN (0, 6)", "large": "contract_price_agree >= 40000", "backward": "announce_gap_days < 0", "month_end": "day(contract_date) >= 25"}
_LIFT = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (({p}) AND ({q})) AS n_both, count(*) FILTER ({p}) AS na, count(*) FILTER ({q}) AS nb, count(*) AS total FROM k" for a, p in _ITEMS.items() for b, q in _ITEMS.items() if a != b)
ORACLES["lift_pairs"] = f"{K} SELECT a, b, n_both, round(n_both / na, 6) AS confidence, round((n_both / na) / (nb / total), 6) AS lift FROM ({_LIFT}) WHERE n_both >= 30"
ORACLES["robust_price_z"] = f"""{K}, q AS (SELECT province, {_D.format('contract_price_agree')} AS price FROM k), m AS (SELECT province, quantile_cont(price, 0.5) AS med FROM q GROUP BY 1), a AS (SELECT q.*, med, abs(price - med) AS d FROM q JOIN m USING (province)),
s AS (SELECT province, quantile_cont(d, 0.5) AS mad FROM a GROUP BY 1), z AS (SELECT a.province, least(10, greatest(-10, (price - med) / (1.4826 * mad))) AS z FROM a JOIN s USING (province))
SELECT province, count(*) AS n, round(max(z), 6) AS max_z, round(min(z), 6) AS min_z, round(avg(z), 6) AS avg_z FROM z GROUP BY 1"""
_BAND4 = f"CASE WHEN log10({_D.format('contract_price_agree')}) > 6.5 THEN 3 WHEN log10({_D.format('contract_price_agree')}) > 5.7 THEN 2 WHEN log10({_D.format('contract_price_agree')}) > 5.3 THEN 1 ELSE 0 END"
ORACLES["peer_rounding"] = f"""{K}, r AS (SELECT dept_key, (purchase_method_name, project_type_name, {_BAND4}) AS peer, CASE WHEN {_V} % 1000 = 0 THEN '000' WHEN {_V} % 100 = 0 THEN 'x00' WHEN {_V} % 10 = 0 THEN 'xx0' ELSE 'xxx' END AS kind FROM k WHERE contract_price_agree >= 1000),
s AS (SELECT peer, kind, count(*) / sum(count(*)) OVER (PARTITION BY peer) AS p FROM r GROUP BY 1, 2), o AS (SELECT dept_key, peer, count(*) AS c FROM r GROUP BY 1, 2), e AS (SELECT dept_key, kind, sum(c * p) AS e FROM o JOIN s USING (peer) GROUP BY 1, 2),
n AS (SELECT dept_key, kind, count(*) AS o FROM r GROUP BY 1, 2), t AS (SELECT e.dept_key, e, coalesce(o, 0) AS o FROM e LEFT JOIN n USING (dept_key, kind)), a AS (SELECT dept_key, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 20)
SELECT dept_key, any_value(n) AS n, round(coalesce(sum((o - e) * (o - e) / e) FILTER (e >= 1), 0), 4) AS chi_squared, CAST(greatest(count(*) FILTER (e >= 1) - 1, 1) AS INTEGER) AS degrees FROM t JOIN a USING (dept_key) GROUP BY 1"""
ORACLES["winner_percentiles"] = f"""{K}, w AS (SELECT winner_key, count(*) AS w_n FROM k GROUP BY 1)
SELECT winner_key, w_n, round((rank() OVER (ORDER BY w_n) + (count(*) OVER (PARTITION BY w_n) - 1) / 2) / count(*) OVER (), 6) AS rank_pct FROM w"""
_METHODS = f"""pm AS (SELECT dept_key, project_id, arg_min(purchase_method_name, (contract_date, contract_no, purchase_method_name)) AS method FROM k WHERE project_money > 100000 GROUP BY 1, 2),
am AS (SELECT dept_key, count(*) AS a_projects, count(*) FILTER (method = '{SPECIFIC_METHOD}') AS a_specific FROM pm GROUP BY 1)"""
ORACLES["eb_posterior"] = f"""{K}, {_METHODS}, u AS (SELECT sum(a_specific)::DOUBLE AS sk, sum(a_projects)::DOUBLE AS sn, count(*) AS g, sum(a_specific::DOUBLE * a_specific / a_projects) AS skk FROM am),
pp AS (SELECT sk / sn AS m, least(1e4, greatest(2.0, (sk / sn) * (1 - sk / sn) / greatest(skk / sn - (sk / sn) * (sk / sn) - (sk / sn) * (1 - sk / sn) * g / sn, 1e-6) - 1)) AS s FROM u)
SELECT dept_key, a_projects, a_specific, round(m * s + a_specific, 4) AS alpha, round((1 - m) * s + a_projects - a_specific, 4) AS beta FROM am, pp"""
_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(c_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(c_lat)) * pow(sin(radians(c_lon - lon) / 2), 2))))"
ORACLES["distance_to_centroid"] = f"""{K}, o AS (SELECT * FROM k WHERE geo_quality = 'ok'), c AS (SELECT province, quantile_cont(lat, 0.5) AS c_lat, quantile_cont(lon, 0.5) AS c_lon FROM o GROUP BY 1 HAVING count(*) >= 3)
SELECT province, count(*) AS n, round(max({_KM}), 3) AS max_km, round(avg({_KM}), 3) AS avg_km FROM o JOIN c USING (province) GROUP BY 1"""
_USER = "(R19 AND CAST(contract_price_agree AS DOUBLE) BETWEEN 20000 AND 90000 AND purchase_method_name != '2-HIGH' AND NOT contains(lower(dept_key), 'united'))"
ORACLES["user_rule_backtest"] = f"""{_S} SELECT count(*) AS total, count(*) FILTER {_USER.replace('(R19', '(WHERE R19', 1)} AS hits, round(count(*) FILTER {_USER.replace('(R19', '(WHERE R19', 1)} / count(*), 6) AS share,
CAST(sum(CASE WHEN {_USER} THEN contract_price_agree END) AS DOUBLE) AS value, count(*) FILTER (WHERE {_USER} AND NOT flagged) AS unflagged, count(*) FILTER (WHERE {_USER} AND risk_score >= 40) AS priority,
count(DISTINCT CASE WHEN {_USER} THEN dept_key END) AS n_agencies, count(DISTINCT CASE WHEN {_USER} THEN winner_key END) AS n_winners FROM s"""
_OVER = " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) FILTER (WHERE {k}) AS n_other, count(*) FILTER (WHERE {k} AND {_USER}) AS n_both, count(*) FILTER (WHERE {_USER}) AS n FROM s" for k in _RULES)
ORACLES["user_rule_overlap"] = f"{_S.replace('s AS (', 's AS MATERIALIZED (')} SELECT rule_id, n_other, n_both, round(n_both / (n_other + n - n_both), 6) AS jaccard FROM ({_OVER}) WHERE n_other > 0"
ORACLES["upsert_orders"] = """WITH b AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 != 0),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Z' END AS st, CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE o_totalprice END AS tp FROM orders WHERE o_orderkey % 2 = 0),
j AS (SELECT b.o_orderkey AS bk, n.o_orderkey AS nk, coalesce(st, b.o_orderstatus) AS o_orderstatus, coalesce(tp, b.o_totalprice) AS o_totalprice, b.o_orderstatus AS bs, b.o_totalprice AS bp FROM b FULL JOIN n ON b.o_orderkey = n.o_orderkey)
SELECT CASE WHEN bk IS NULL THEN 'added' WHEN nk IS NOT NULL AND (o_orderstatus IS DISTINCT FROM bs OR o_totalprice IS DISTINCT FROM bp) THEN 'updated' ELSE 'kept' END AS merge_kind, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM j GROUP BY 1, 2"""
ORACLES["append_orders"] = "SELECT o_orderstatus, extra, count(*) AS n FROM (SELECT o_orderstatus, CAST(NULL AS INTEGER) AS extra FROM orders UNION ALL SELECT NULL, 1 FROM orders WHERE o_orderkey % 7 = 0) GROUP BY 1, 2"
ORACLES["graph_degrees"] = f"""{K}, e AS (SELECT 'A::' || dept_key AS s, 'C::' || winner_key AS t, sum(contract_price_agree) AS v FROM k GROUP BY 1, 2)
SELECT id, count(*) AS degree, CAST(sum(v) AS DOUBLE) AS weighted_degree FROM (SELECT s AS id, v FROM e UNION ALL SELECT t, v FROM e) GROUP BY 1"""


def _graph_sql(least: int, levels: int = 10, rounds: int = 20) -> str:
    """Table expressions of the graph of pairs with `least` contracts: b (betweenness from the first 400 nodes by digest) and r
    (PageRank). Levels and rounds are written out; the supplied graphs have fewer levels."""
    pair = "SELECT 'A::' || dept_key AS s, 'C::' || winner_key AS t, CAST(sum(contract_price_agree) AS DOUBLE) AS v FROM k GROUP BY 1, 2"
    out = [f"{K}, e AS MATERIALIZED ({pair} HAVING count(*) >= {least})", "links AS MATERIALIZED (SELECT s AS id, t AS other, v FROM e UNION ALL SELECT t, s, v FROM e)"]
    out += ["g AS MATERIALIZED (SELECT id, count(*) AS degree, sum(v) AS v FROM links GROUP BY 1)", "n AS MATERIALIZED (SELECT count(*) AS n FROM g)"]
    out += ["l0 AS MATERIALIZED (SELECT id AS p, id AS x, 1.0::DOUBLE AS q FROM (SELECT id FROM g ORDER BY md5('42:' || id), id LIMIT 400))"]
    for i in range(1, levels + 1):
        old = " UNION ALL ".join(f"SELECT p, x FROM l{j}" for j in range(max(i - 2, 0), i))
        out.append(f"l{i} AS MATERIALIZED (SELECT l.p, h.other AS x, sum(l.q) AS q FROM l{i - 1} l JOIN links h ON h.id = l.x WHERE (l.p, h.other) NOT IN ({old}) GROUP BY 1, 2)")
    out.append(f"d{levels} AS (SELECT *, 0.0::DOUBLE AS d FROM l{levels})")
    for i in range(levels - 1, 0, -1):
        sums = f"SELECT d.p, h.other AS x, sum((1 + d.d) / d.q) AS s FROM d{i + 1} d JOIN links h ON h.id = d.x GROUP BY 1, 2"
        out.append(f"d{i} AS MATERIALIZED (SELECT l.p, l.x, l.q, coalesce(w.s, 0) * l.q AS d FROM l{i} l LEFT JOIN ({sums}) w ON w.p = l.p AND w.x = l.x)")
    parts = " UNION ALL ".join(f"SELECT x, d FROM d{i}" for i in range(1, levels + 1))
    out.append(f"b AS MATERIALIZED (SELECT g.id, coalesce(sum(d), 0) * any_value(n) / least(400, any_value(n)) / ((any_value(n) - 1) * (any_value(n) - 2)) AS betweenness FROM g CROSS JOIN n LEFT JOIN ({parts}) ON x = g.id GROUP BY 1)")
    out.append("r0 AS (SELECT id, 1.0 / n AS rank FROM g, n)")
    for i in range(1, rounds + 1):
        out.append(f"r{i} AS MATERIALIZED (SELECT h.other AS id, 0.15::DOUBLE / any_value(n) + 0.85 * sum(h.v / g.v * r.rank) AS rank FROM links h JOIN g ON g.id = h.id JOIN r{i - 1} r ON r.id = h.id CROSS JOIN n GROUP BY 1)")
    return ", ".join(out)


def _composite_sql(least: int) -> str:
    place = ", ".join(f"round(100 * (row_number() OVER (ORDER BY {c}, id) - 1) / (count(*) OVER () - 1), 2) AS {c}_n" for c in ("degree", "weighted_degree", "pagerank", "betweenness"))
    total = " + ".join(f"{w}::DECIMAL(3,2) * CAST({c}_n AS DECIMAL(7,2))" for c, w in (("degree", "0.30"), ("weighted_degree", "0.30"), ("pagerank", "0.20"), ("betweenness", "0.20")))
    return f"""{_graph_sql(least)}, m AS (SELECT id, degree, v AS weighted_degree, round(rank, 12) AS pagerank, round(betweenness, 12) AS betweenness FROM g JOIN r20 USING (id) JOIN b USING (id)),
c AS (SELECT *, {place} FROM m) SELECT * REPLACE (round(pagerank, 8) AS pagerank, round(betweenness, 8) AS betweenness), CASE WHEN id[1] = 'A' THEN 'agency' ELSE 'contractor' END AS type, id[4:] AS name, CAST(round({total}, 2) AS DOUBLE) AS composite FROM c"""


ORACLES["graph_betweenness"] = f"{_graph_sql(30)} SELECT id, round(betweenness, 8) AS betweenness FROM b"
ORACLES["composite_ranks"] = _composite_sql(1)
ORACLES["composite_ranks_strong"] = _composite_sql(30)
ORACLES["part_name_groups"] = """WITH c AS (SELECT [x for x in [CASE WHEN regexp_matches(p_type, 'STEEL|steel') THEN 'steel' END, CASE WHEN regexp_matches(p_type, 'BRASS|brass') THEN 'brass' END, CASE WHEN regexp_matches(p_type, 'PROMO') THEN 'promo' END,
CASE WHEN regexp_matches(p_type, 'ECONOMY') THEN 'economy' END] if x IS NOT NULL] AS g FROM part), a AS (SELECT unnest(g) AS "group", 1 AS x FROM c), f AS (SELECT coalesce(g[1], 'other') AS "group" FROM c),
ac AS (SELECT "group", count(*) AS n_any FROM a GROUP BY 1), fc AS (SELECT "group", count(*) AS n_primary FROM f GROUP BY 1)
SELECT coalesce(ac."group", fc."group") AS "group", coalesce(n_any, 0) AS n_any, coalesce(n_primary, 0) AS n_primary FROM ac FULL JOIN fc ON ac."group" = fc."group\""""
ORACLES["part_name_terms"] = "SELECT term, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split_regex(p_type, '[\\s()]+')) AS term FROM part) WHERE length(term) > 2 GROUP BY 1 HAVING count(*) >= 5"
_W = "list_distinct([w for w in string_split_regex(project_name || ' ' || project_type_name, '[\\s()]+') if length(w) > 2])"
ORACLES["near_repeated_names"] = f"""{K}, t AS (SELECT dept_key, project_id, contract_no, contract_date, {_W} AS w FROM k WHERE len({_W}) > 0),
j AS (SELECT a.dept_key, (a.project_id, a.contract_no, a.contract_date) AS x, (b.project_id, b.contract_no, b.contract_date) AS y, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS u
FROM t a JOIN t b ON a.dept_key = b.dept_key AND abs(date_diff('day', a.contract_date, b.contract_date)) <= 30 AND a.project_id != b.project_id)
SELECT DISTINCT dept_key, x[1] AS project_a, x[2] AS contract_a, y[1] AS project_b, y[2] AS contract_b, round(i / u, 6) AS jaccard FROM j WHERE 100 * i >= 80 * u AND x < y"""
ORACLES["money_texts"] = "SELECT count(*) AS parsed, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total FROM orders WHERE o_orderkey % 11 != 0"
ORACLES["era_dates"] = "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'iso' WHEN 1 THEN 'slash' ELSE 'empty' END AS format, count(*) AS n, min(CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END) AS first, max(CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END) AS last FROM orders GROUP BY 1"
ORACLES["supplier_names"] = "SELECT s_suppkey, 'ห้างหุ้นส่วนจำกัด ' || s_name AS name FROM supplier"
ORACLES["event_bursts"] = "SELECT user_id, max(n) AS burst FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1"
ORACLES["event_props"] = "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2"
ORACLES["benford_chi_squared"] = f"""{K}, d AS (SELECT dept_key, CAST(substr(CAST(CAST(floor(contract_price_agree) AS BIGINT) AS VARCHAR), 1, 1) AS INTEGER) AS digit, count(*) AS n FROM k WHERE contract_price_agree >= 1 GROUP BY 1, 2),
e AS (SELECT *, round(sum(n) OVER (PARTITION BY dept_key) * log10(1 + 1 / digit), 4) AS x FROM d)
SELECT dept_key, CAST(sum(n) AS BIGINT) AS n, round(sum(pow(n - x, 2) / x) + sum(n) - sum(x), 4) AS chi_squared FROM e GROUP BY 1 HAVING sum(n) >= 30"""
ORACLES["underbid_peers"] = f"""{K}, d AS (SELECT *, 1 - {_D.format('contract_price_agree')} / {_D.format('price_build')} AS discount FROM k WHERE contract_price_agree > 0 AND price_build > 0),
p AS (SELECT purchase_method_name, project_type_name, quantile_cont(discount, 0.5) AS med FROM d GROUP BY 1, 2 HAVING count(*) >= 10), u AS (SELECT d.*, round(discount - med, 6) AS under FROM d JOIN p USING (purchase_method_name, project_type_name))
SELECT purchase_method_name, project_type_name, count(*) AS n, max(under) AS most, min(under) AS least FROM u GROUP BY 1, 2"""

"""Registered queries of the contract engine: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import band, canonical_name, haversine_km, money, thai_date
from ..functions.stats import percent_rank_average, robust_z
from ..operators import analytics, autoencoder, context, digits, dsl, graph, merge, models, patterns, reports, rules, text
from ..tables import written
from .contracts import contracts, table, viewed

QUERIES: dict = {}
#: Rules whose hits SQL can tell without a Beta tail or a geographic median.
PLAIN_RULES = ("R1", "R2", "R3", "R4", "R7", "R9", "R10", "R11", "R12", "R13", "R14", "R15", "R16", "R19", "R20", "R21", "R22", "R23")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(viewed(spark, sf_dir), rules.configured(only=PLAIN_RULES))


@query
def risk_score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.bands(_scored(spark, sf_dir))


@query
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.summarize(_scored(spark, sf_dir))


@query
def rule_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 21 rules, those with Beta tails and distances too."""
    return rules.summarize(rules.evaluate(viewed(spark, sf_dir)))


@query
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.coverage(_scored(spark, sf_dir), rules.configured(only=PLAIN_RULES))


@query
def rule_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.overlap(_scored(spark, sf_dir))


@query
def what_if_without_r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.what_if(_scored(spark, sf_dir), exclude=["R3"], rules=rules.configured(only=PLAIN_RULES))
    return got.groupBy(band(F.col("what_if_score")).alias("band")).agg(F.count("*").alias("n"), F.round(F.sum("what_if_score"), 2).alias("score"))


@query
def sensitivity_r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.sensitivity(contracts(spark, sf_dir), rules.default_rules()["R1"], "pct")


@query
def project_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_double(context.projects(contracts(spark, sf_dir)), "p_sum", "p_total")


@query
def over_budget_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir)
    p = context.projects(c).join(c.groupBy("project_id").agg(F.max("project_money").alias("money")), "project_id")
    over = p.filter(F.col("p_total").cast("double") / F.col("money").cast("double") > 1.0)
    return over.select("project_id", "p_n", F.round(F.col("p_total").cast("double") / F.col("money").cast("double"), 6).alias("ratio"))


@query
def same_day_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = context.same_day_groups(contracts(spark, sf_dir)).filter((F.col("g_n") >= 2) | (F.col("g_projects") >= 2))
    return _as_double(g, "g_total", "g_max")


@query
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pair_patterns(contracts(spark, sf_dir))


@query
def burst30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.bursts(contracts(spark, sf_dir), ["dept_key", "winner_key"])


@query
def spread30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.spread_splits(contracts(spark, sf_dir), each_below=50_000, total_at=60_000)


@query
def rotation_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.rotation(contracts(spark, sf_dir), least_coverage=0.005)


@query
def monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.monthly(contracts(spark, sf_dir))


@query
def weekday_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.weekdays(contracts(spark, sf_dir))


@query
def same_day_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.same_day(contracts(spark, sf_dir), least=2)


@query
def method_price_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.method_prices(contracts(spark, sf_dir))


@query
def same_price_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.same_price_groups(contracts(spark, sf_dir), least=2)


@query
def round_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.round_prices(contracts(spark, sf_dir), 50_000)


@query
def discount_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.discount_bins(contracts(spark, sf_dir))


@query
def contractor_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = patterns.contractors(viewed(spark, sf_dir), ceiling=50_000)
    return got.withColumn("archetypes", F.array_join("archetypes", ","))


@query
def hhi_by_agency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.hhi(contracts(spark, sf_dir))


@query
def price_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = analytics.outliers(contracts(spark, sf_dir), "contract_price_agree", ["purchase_method_name"], k=0.5)
    return got.select("project_id", "contract_no", "winner_key", F.col("contract_price_agree").cast("double").alias("price"), "times_median")


@query
def duration_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = analytics.outliers(contracts(spark, sf_dir).filter("duration_days >= 0"), "duration_days", ["province"], k=0.3)
    return got.groupBy("province").agg(F.count("*").alias("n"), F.max("duration_days").alias("longest"))


@query
def threshold_cliff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.threshold_cliff(contracts(spark, sf_dir), 50_000, 5_000)


@query
def price_ratio_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.ratio_histogram(contracts(spark, sf_dir))


@query
def fiscal_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.fiscal_quarters(contracts(spark, sf_dir))


@query
def province_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.time_series(contracts(spark, sf_dir), "province", ["AFRICA", "ASIA", "EUROPE"])


@query
def repeat_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.repeat_winners(contracts(spark, sf_dir))


@query
def new_winner_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.new_winner_share(contracts(spark, sf_dir))


@query
def stacked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.stacked_points(contracts(spark, sf_dir), cell=0.5)


@query
def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.network_edges(_scored(spark, sf_dir))


@query
def queue_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.queue_coverage(_scored(spark, sf_dir))


@query
def agency_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.agency_profiles(contracts(spark, sf_dir))


@query
def benford_first_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.first_digits(contracts(spark, sf_dir), "dept_key")


@query
def round_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.round_shares(contracts(spark, sf_dir))


@query
def table_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.scope(contracts(spark, sf_dir))


@query
def lift_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = {"specific": F.col("purchase_method_name") == "เฉพาะเจาะจง", "weekend": F.dayofweek("contract_date").isin(1, 7), "large": F.col("contract_price_agree") >= 40_000, "backward": F.col("announce_gap_days") < 0, "month_end": F.day("contract_date") >= 25}
    return analytics.lift_pairs(contracts(spark, sf_dir), items)


@query
def robust_price_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = written(contracts(spark, sf_dir).select("province", F.col("contract_price_agree").cast("double").alias("price")))
    z = robust_z(c, "price", ["province"], "z")
    return z.groupBy("province").agg(F.count("*").alias("n"), F.round(F.max("z"), 6).alias("max_z"), F.round(F.min("z"), 6).alias("min_z"), F.round(F.avg("z"), 6).alias("avg_z"))


@query
def winner_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = context.winners(contracts(spark, sf_dir))
    return percent_rank_average(w, "w_n", [], "share").select("winner_key", "w_n", F.round("share", 6).alias("rank_pct"))


@query
def eb_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.stats import with_posterior

    got = with_posterior(context.agency_methods(contracts(spark, sf_dir), 100_000), "a_specific", "a_projects")
    return got.select("dept_key", "a_projects", "a_specific", F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"))


@query
def direct_purchase_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.agency_direct_share(contracts(spark, sf_dir), 0.2, 100_000).withColumn("a_confidence", F.round("a_confidence", 6))


@query
def distance_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir).filter("geo_quality = 'ok'")
    placed = c.join(context.centroids(c), "province")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    return placed.groupBy("province").agg(F.count("*").alias("n"), F.round(F.max(km), 3).alias("max_km"), F.round(F.avg(km), 3).alias("avg_km"))


@query
def user_rule_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.backtest(_scored(spark, sf_dir), USER_RULE)


USER_RULE = {"name": "weekend, dear and late", "weight": 12, "match": "all", "conditions": [
    {"field": "weekend", "op": "is", "value": True}, {"field": "contract_price_agree", "op": "between", "value": [20_000, 90_000]},
    {"field": "purchase_method_name", "op": "not_in", "value": ["2-HIGH"]}, {"field": "dept_key", "op": "not_contains", "value": "united"}]}


@query
def user_rule_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.backtest_overlap(_scored(spark, sf_dir), USER_RULE, top=30)


@query
def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    base = o.filter("o_orderkey % 3 != 0")
    new = o.filter("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, "Z").otherwise("")).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.lit(1.0)).otherwise(F.col("o_totalprice")))
    return merge.upsert(base, new, ("o_orderkey",)).groupBy("merge_kind", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query
def append_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    both = merge.append(o.select("o_orderkey", "o_orderstatus"), o.filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit(1).alias("extra")))
    return both.groupBy("o_orderstatus", "extra").agg(F.count("*").alias("n"))


@query
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.edges(contracts(spark, sf_dir)))


@query
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.percentile(graph.pagerank(graph.edges(contracts(spark, sf_dir))), "rank", "place")


@query
def graph_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the graph of pairs with 30 contracts or more: in the supplied view every agency deals with every winner."""
    strong = graph.edges(viewed(spark, sf_dir)).filter("n >= 30")
    return graph.betweenness(strong).withColumn("betweenness", F.round("betweenness", 8))


@query
def composite_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.composite(graph.edges(viewed(spark, sf_dir)))
    return got.withColumns({c: F.round(c, 8) for c in ("pagerank", "betweenness")})


@query
def composite_ranks_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among pairs with 30 contracts or more, which differ in all four measures."""
    got = graph.composite(graph.edges(viewed(spark, sf_dir)).filter("n >= 30"))
    return got.withColumns({c: F.round(c, 8) for c in ("pagerank", "betweenness")})


@query
def part_name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = (("steel", "STEEL|steel"), ("brass", "BRASS|brass"), ("promo", "PROMO"), ("economy", "ECONOMY"))
    return text.group_counts(table(spark, sf_dir, "part").select(F.col("p_type").alias("project_name")), groups)


@query
def part_name_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.term_counts(table(spark, sf_dir, "part").select(F.col("p_type").alias("project_name")))


@query
def near_repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir).withColumn("project_name", F.concat_ws(" ", "project_name", "project_type_name"))
    return text.near_repeats(c, ["dept_key"])


@query
def kmeans_contractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.cluster_contractors(patterns.contractors(viewed(spark, sf_dir)))


@query
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.anomaly_scores(viewed(spark, sf_dir), keep=["project_id", "contract_no", "winner_key"]).select("project_id", "contract_no", "winner_key", F.round("ml_score", 4).alias("ml_score"))


@query
def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.associations(_scored(spark, sf_dir))


@query
def discount_hurdle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = models.hurdle(contracts(spark, sf_dir))
    return got.groupBy("dept_key").agg(F.count("*").alias("n"), F.round(F.avg("p_zero"), 4).alias("p_zero"), F.round(F.avg("depth_residual"), 4).alias("depth_residual"))


@query
def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written as amounts of money and parsed again."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    written = F.when(F.col("o_orderkey") % 11 == 0, "-").otherwise(F.concat(F.lit("฿"), F.format_number("o_totalprice", 2), F.lit(" บาท")))
    return o.select(money(written).alias("m"), "o_totalprice").agg(F.count("m").alias("parsed"), F.sum("m").cast("double").alias("total"))


@query
def era_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in the Buddhist era and parsed again, by format."""
    d = F.to_date("o_orderdate")
    iso = F.concat_ws("-", (F.year(d) + 543).cast("string"), F.lpad(F.month(d).cast("string"), 2, "0"), F.lpad(F.day(d).cast("string"), 2, "0"))
    slash = F.concat_ws("/", F.day(d).cast("string"), F.month(d).cast("string"), (F.year(d) + 543).cast("string"))
    written = F.when(F.col("o_orderkey") % 3 == 0, iso).when(F.col("o_orderkey") % 3 == 1, slash).otherwise("n/a")
    parsed, kind = thai_date(written)
    return table(spark, sf_dir, "orders").select(kind.alias("format"), parsed.alias("parsed")).groupBy("format").agg(F.count("*").alias("n"), F.min("parsed").alias("first"), F.max("parsed").alias("last"))


@query
def supplier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    written = F.concat(F.lit("ห้างหุ้นส่วนจำกัด  ห้างหุ้นส่วนจำกัด "), F.col("s_name"))
    return s.select("s_suppkey", canonical_name(written).alias("name"))


@query
def event_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most events of a user within any day."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return e.select("user_id", F.count("*").over(w).alias("n")).groupBy("user_id").agg(F.max("n").alias("burst"))


@query
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query
def benford_chi_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.benford_test(contracts(spark, sf_dir)).drop("p_value")


@query
def underbid_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = analytics.underbids(contracts(spark, sf_dir))
    return got.groupBy("purchase_method_name", "project_type_name").agg(F.count("*").alias("n"), F.max("under").alias("most"), F.min("under").alias("least"))


CONTRACT = ["project_id", "contract_no", "winner_key", "contract_date", "contract_price_agree"]


def _told(df: DataFrame, score: str) -> DataFrame:
    """A row per factor of an explained contract."""
    each = df.select(*CONTRACT, F.round(score, 4).alias(score), F.posexplode_outer("factors").alias("place", "f"))
    return each.select(*CONTRACT[:-1], F.col("contract_price_agree").cast("double").alias("price"), score, "place", "f.feature", F.round("f.delta", 4).alias("delta"), F.round("f.value", 3).alias("value"), F.round("f.peer", 3).alias("peer"))


@query
def anomaly_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes the 400 oddest contracts odd: features whose usual value would lower the forest's score."""
    return _told(models.explain_anomalies(viewed(spark, sf_dir), CONTRACT), "ml_score")


@query
def deep_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the networks' errors."""
    return _told(autoencoder.explain_deep(viewed(spark, sf_dir), CONTRACT), "deep_error")


@query
def forest_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.forest_stability(viewed(spark, sf_dir), CONTRACT)


@query
def component_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = autoencoder.component_errors(viewed(spark, sf_dir), keep=["project_id", "contract_no", "winner_key"])
    return got.select("project_id", "contract_no", "winner_key", "fold", F.round("pca_error", 6).alias("pca_error"))


@query
def hurdle_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.hurdle_quality(contracts(spark, sf_dir))


@query
def score_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts by how many of the three engines (rules, forest, networks) flag them, and by the only one that does."""
    return reports.agreement(_both_scores(spark, sf_dir, ["risk_score"]), {"rules": F.col("risk_score") >= 40, "forest": F.col("ml_pct") >= 95, "networks": F.col("deep_pct") >= 95})


@query
def deep_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the networks' score ranks contracts of projects over budget. In this view every contract shares its number
    with another of its agency, so R20, a sure error too, would label all of them."""
    labelled = written(_both_scores(spark, sf_dir, [*CONTRACT, "hit_mask"])).withColumn("label", rules.struck("R4"))
    return reports.proxy_evaluation(labelled, "label", "deep_pct", CONTRACT)


def _both_scores(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    """Contracts, of their columns and those of the rules those in `keep`, with the percentiles of both models' scores (the
    networks' within the scoring group)."""
    # Features read the contracts ten times over: rules are evaluated once, before. What rules alone read goes.
    c = _scored(spark, sf_dir).drop("p_n", "p_sum", "p_missing", "rule_hits", "max_severity", "max_severity_all", "risk_band")
    featured, columns = autoencoder.folded(written(c, split_mb=16, wide=True), keep=keep)
    nets, scales = autoencoder.fit(featured.select("fold", "held", *columns), columns)
    forest = models.grow(featured, columns)
    rows = models.scored(featured, columns, {"ml_score": forest.score}, [*keep, models.GROUP, "fold", *columns])
    rows = written(autoencoder._errors(rows, columns, [*keep, models.GROUP, "ml_score"], "deep_error", autoencoder.networks_error(nets, scales, len(columns))))
    return reports.group_percentile(reports.group_percentile(rows, "ml_score", [], "ml_pct"), "deep_error", [models.GROUP], "deep_pct")


@query
def mined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the types of parts that name no metal."""
    p = table(spark, sf_dir, "part").select(F.concat_ws(" / ", "p_type", "p_brand").alias("project_name"))
    return text.mine_terms(p, (("steel", "STEEL"), ("brass", "BRASS")))


@query
def digit_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digits.audit(viewed(spark, sf_dir))


@query
def sibling_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = digits.sibling_test(viewed(spark, sf_dir))
    return got.select("org", "sub", "n", F.round("mad", 6).alias("mad"), "p")


@query
def peer_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = digits.peer_test(viewed(spark, sf_dir))
    return got.select("dept_key", "n", F.round("chi_squared", 4).alias("chi_squared"), "degrees").withColumn("n", F.col("n").cast("long"))


@query
def autoencoder_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = autoencoder.deep_scores(viewed(spark, sf_dir), keep=["project_id", "contract_no", "winner_key"])
    return got.select("project_id", "contract_no", "winner_key", "fold", F.round("deep_error", 4).alias("deep_error"))

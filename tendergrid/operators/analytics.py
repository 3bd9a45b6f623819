"""Market, outlier, calendar and queue analytics over contracts.

Where the behaviour is known only from its use, what is chosen here is stated in the docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parse import round_kind
from ..functions.stats import quantiles
from ..tables import written


def _price() -> Column:
    return F.col("contract_price_agree")


def hhi(c: DataFrame, by: str = "dept_key", least: int = 5) -> DataFrame:
    """Concentration per agency: the sum of squared percentage shares of value, over agencies with enough contracts."""
    own = c.filter((_price() > 0) & F.col("winner_key").isNotNull()).groupBy(by, "winner_key").agg(F.sum("contract_price_agree").alias("v"), F.count("*").alias("n"))
    total = own.groupBy(by).agg(F.sum("v").alias("total"), F.sum("n").alias("n_contracts"), F.count("*").alias("n_winners"), F.max("v").alias("top")).filter(F.col("n_contracts") >= least)
    share = F.col("v").cast("double") / F.col("total").cast("double") * 100
    return own.join(total, by).groupBy(by, "n_contracts", "n_winners").agg(F.round(F.sum(share * share), 4).alias("hhi"), F.round(F.max(share), 4).alias("top_winner_share"))


def outliers(c: DataFrame, value: str, by: list[str], k: float = 3.0, least: int = 30) -> DataFrame:
    """Rows above the third quartile by k interquartile ranges of their group, with the times of its median."""
    x = F.col(value).cast("double")
    q = quantiles(c, value, by, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}).filter(F.col("n") >= least)
    bound = F.col("_q3") + k * (F.col("_q3") - F.col("_q1"))
    return c.join(q.drop("n"), by).filter(x > bound).withColumn("times_median", F.round(F.when(F.col("_q2") != 0, x / F.col("_q2")), 4)).drop("_q1", "_q2", "_q3")


def threshold_cliff(c: DataFrame, ceiling: float = 500_000, width: float = 50_000, bins: int = 10) -> DataFrame:
    """Contracts in bins of equal width on both sides of a ceiling; side -1 is below."""
    bin_ = F.floor((_price().cast("double") - ceiling) / width).cast("long")
    return c.filter(_price() > 0).select(bin_.alias("bin")).filter((F.col("bin") >= -bins) & (F.col("bin") < bins)).groupBy("bin").agg(F.count("*").alias("n")).withColumn("side", F.when(F.col("bin") < 0, -1).otherwise(1))


def ratio_histogram(c: DataFrame, bins: int = 20) -> DataFrame:
    """price / reference price in bins of 1 / bins; exact ones counted apart."""
    r = _price().cast("double") / F.col("price_build").cast("double")
    priced = c.filter((F.col("price_build") > 0) & _price().isNotNull()).select(F.floor(F.round(r, 9) * bins).cast("long").alias("bin"), (F.abs(r - 1) < 1e-6).alias("exact"))
    return priced.groupBy("bin").agg(F.count("*").alias("n"), F.count_if("exact").alias("n_exact"))


def audit_queue(evaluated: DataFrame, n: int, mode: str = "exposure") -> DataFrame:
    """The first n contracts by exposure (score times value), score or value."""
    key = {"exposure": F.col("risk_score") * _price().cast("double"), "score": F.col("risk_score"), "value": _price().cast("double")}[mode]
    order = [F.desc("_key"), F.desc("contract_price_agree"), "project_id", "contract_no", "winner_key", "contract_date"]
    return evaluated.filter(F.col("risk_score") > 0).withColumn("_key", key).orderBy(*order).limit(n).withColumnRenamed("_key", "queue_key")


def queue_coverage(evaluated: DataFrame, sizes: tuple[int, ...] = (10, 50, 100, 500)) -> DataFrame:
    """Share of all exposure that the first contracts of each ordering cover; the sizes are the report's."""
    exposure = F.col("risk_score") * _price().cast("double")
    evaluated = written(evaluated.select("risk_score", "contract_price_agree", "project_id", "contract_no", "winner_key", "contract_date"))
    total = evaluated.agg(F.sum(exposure)).first()[0] or 0.0
    out = None
    for mode in ("exposure", "score", "value"):
        top = audit_queue(evaluated, max(sizes), mode).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("queue_key"), F.desc("contract_price_agree"), "project_id", "contract_no", "winner_key", "contract_date")))
        got = top.agg(*[F.sum(F.when(F.col("rank") <= s, exposure)).alias(str(s)) for s in sizes])
        rows = F.array(*[F.struct(F.lit(s).alias("size"), F.round(F.col(f"`{s}`") / total, 6).alias("covered")) for s in sizes])
        part = got.select(F.lit(mode).alias("mode"), F.explode(rows).alias("x")).select("mode", "x.size", "x.covered")
        out = part if out is None else out.unionByName(part)
    return out


def fiscal_quarters(c: DataFrame) -> DataFrame:
    """Contracts per fiscal year, which starts in October and is named after the year it ends in, and quarter."""
    shifted = F.add_months("contract_date", 3)
    return c.filter(F.col("contract_date").isNotNull()).groupBy(F.year(shifted).alias("fiscal_year"), F.quarter(shifted).alias("fiscal_quarter")).agg(F.count("*").alias("n"), F.sum("contract_price_agree").cast("double").alias("value"))


def time_series(c: DataFrame, dimension: str, values: list[str]) -> DataFrame:
    """Contracts per month, a column for each of the values."""
    return c.filter(F.col("contract_date").isNotNull()).groupBy(F.date_format("contract_date", "yyyy-MM").alias("month")).pivot(dimension, values).agg(F.count(F.lit(1))).na.fill(0)


def repeat_winners(c: DataFrame, least: int = 3) -> DataFrame:
    out = c.groupBy("winner_key").agg(F.count_distinct("dept_key").alias("n_agencies"), F.count("*").alias("n_contracts"), F.sum("contract_price_agree").cast("double").alias("total_value"))
    return out.filter(F.col("n_agencies") >= least)


def new_winner_share(c: DataFrame) -> DataFrame:
    """Per month: winners, and the share of them that had never won before it."""
    first = c.groupBy("winner_key").agg(F.date_format(F.min("contract_date"), "yyyy-MM").alias("first_month"))
    months = c.select("winner_key", F.date_format("contract_date", "yyyy-MM").alias("month")).distinct()
    return months.join(first, "winner_key").groupBy("month").agg(F.count("*").alias("n_winners"), F.round(F.count_if(F.col("month") == F.col("first_month")) / F.count("*"), 6).alias("new_share"))


def network_edges(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy(F.col("dept_key").alias("source"), F.col("winner_key").alias("target")).agg(F.count("*").alias("n"), F.sum("contract_price_agree").cast("double").alias("value"), F.max("risk_score").alias("max_risk"), F.count_if(F.col("hit_mask") != 0).alias("flagged"))


def stacked_points(c: DataFrame, cell: float = 0.005, least: int = 3) -> DataFrame:
    """Cells of the map with several contracts: exact where all share one point, else cluster."""
    key = [F.floor(F.col(x) / cell + 1e-9).cast("long").alias(f"cell_{x}") for x in ("lat", "lon")]
    out = c.filter(F.col("lat").isNotNull()).groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("lat", "lon").alias("points"))
    return out.filter(F.col("n") >= least).withColumn("kind", F.when(F.col("points") == 1, "exact").otherwise("cluster"))


def shared_places(c: DataFrame, least: int = 3, top: int = 8) -> DataFrame:
    """The places with most contracts of those whose text stands at `least` contracts and names or more: contracts, names,
    agencies, and the commonest agency and province, the smallest of those that tie. A null name or agency counts as one
    of its own, but isn't the commonest; a text that is empty or a dash is no place. Ties in order of the text."""
    placed = c.withColumn("_place", F.trim("project_location")).filter(~F.col("_place").isin("", "-"))
    kinds = lambda x: F.count_distinct(x) + F.max(F.col(x).isNull().cast("int"))
    groups = placed.groupBy("_place").agg(F.count("*").alias("n"), kinds("project_name").alias("names"), kinds("dept_key").alias("depts"))
    best = groups.filter((F.col("n") >= least) & (F.col("names") >= least)).orderBy(F.desc("n"), "_place").limit(top)
    own = placed.join(best.select("_place"), "_place")
    for x, name in (("dept_key", "dept"), ("province", "province")):
        counts = own.filter(F.col(x).isNotNull()).groupBy("_place", x).agg(F.count("*").alias("_n"))
        best = best.join(counts.groupBy("_place").agg(F.min(F.struct(-F.col("_n"), x))[x].alias(name)), "_place", "left")
    return best.withColumnRenamed("_place", "place")


def agency_profiles(c: DataFrame) -> DataFrame:
    from ..functions.parse import method_group

    # Read twice, so the four columns that count are written: joins that c rests on run once.
    c = written(c.select("dept_key", "winner_key", "purchase_method_name", "contract_price_agree"))
    own = c.groupBy("dept_key").agg(F.count("*").alias("n_contracts"), F.count_distinct("winner_key").alias("n_winners"), F.round(F.count_if(method_group(F.col("purchase_method_name")) == "เฉพาะเจาะจง") / F.count("*"), 6).alias("specific_share"), F.round(F.stddev_samp(_price().cast("double")) / F.avg(_price().cast("double")), 6).alias("cv"))
    return own.join(hhi(c).select("dept_key", "hhi", "top_winner_share"), "dept_key", "left")


def first_digits(c: DataFrame, by: str | None = None) -> DataFrame:
    """First digits of prices against Benford's law."""
    keys = [by] if by else []
    digit = F.substring(F.floor(_price()).cast("string"), 1, 1).cast("int")
    out = c.filter(_price() >= 1).groupBy(*keys, digit.alias("digit")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0)))
    return out.withColumn("expected", F.round(total * F.log10(1 + 1 / F.col("digit")), 4))


def round_shares(c: DataFrame, by: str = "dept_key") -> DataFrame:
    kind = round_kind(_price())
    out = c.filter(_price() > 0).groupBy(by, kind.alias("kind")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(by)), 6))


def significant_share(p_values: DataFrame, p: str, q: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: how many of the tests are significant at rate q; one row."""
    everything = W.partitionBy(F.lit(0))
    ranked = p_values.filter(F.col(p).isNotNull()).withColumn("r", F.row_number().over(everything.orderBy(p))).withColumn("m", F.count("*").over(everything))
    return ranked.agg(F.coalesce(F.max(F.when(F.col(p) <= q * F.col("r") / F.col("m"), F.col("r"))), F.lit(0)).alias("n_significant"), F.max("m").alias("n_tests"))


def scope(c: DataFrame) -> DataFrame:
    """One row: size, dates, distinct values and gaps of a table."""
    return c.agg(F.count("*").alias("n"), F.count_distinct("project_id").alias("n_projects"), F.count_distinct("dept_key").alias("n_agencies"), F.count_distinct("winner_key").alias("n_winners"), F.min("contract_date").alias("first_date"), F.max("contract_date").alias("last_date"), F.sum("contract_price_agree").cast("double").alias("value"), F.count_if(_price().isNull()).alias("n_unpriced"), F.count_if(F.col("duration_days") < 0).alias("n_backward"))


def lift_pairs(c: DataFrame, items: dict, least: int = 30) -> DataFrame:
    """Pairs of categorical items of a contract with support, confidence and lift; pairs within a row only."""
    rows = c.select(F.array_sort(F.array_compact(F.array(*[F.when(p, k) for k, p in items.items()]))).alias("items"))
    total = rows.agg(F.count("*").alias("total"))
    one = rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    two = rows.select(F.explode("items").alias("a"), "items").select("a", F.explode("items").alias("b")).filter("a != b").groupBy("a", "b").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= least)
    out = two.join(one.toDF("a", "n_a"), "a").join(one.toDF("b", "n_b"), "b").withColumn("total", F.lit(total.first()[0]))
    confidence = F.col("n_both") / F.col("n_a")
    return out.select("a", "b", "n_both", F.round(confidence, 6).alias("confidence"), F.round(confidence / (F.col("n_b") / F.col("total")), 6).alias("lift"))


def benford_test(c: DataFrame, by: str = "dept_key", least: int = 30) -> DataFrame:
    """Chi-squared of first digits against Benford's law per group, with its chance at 8 degrees of freedom."""
    digits = first_digits(c, by)
    term = F.pow(F.col("n") - F.col("expected"), F.lit(2)) / F.col("expected")
    out = digits.groupBy(by).agg(F.sum("n").alias("n"), F.sum(term).alias("seen"), F.sum("expected").alias("covered")).filter(F.col("n") >= least)
    chi = F.col("seen") + F.col("n") - F.col("covered")
    h = chi / 2
    tail = F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)
    return out.select(by, "n", F.round(chi, 4).alias("chi_squared"), F.round(tail, 6).alias("p_value"))


def underbids(c: DataFrame, least: int = 10) -> DataFrame:
    """Discount of each contract less the median of its method and project type."""
    d = c.filter((_price() > 0) & (F.col("price_build") > 0)).withColumn("discount", 1 - _price().cast("double") / F.col("price_build").cast("double"))
    key = ["purchase_method_name", "project_type_name"]
    peers = quantiles(d, "discount", key, {"peer_median": 0.5}).withColumnRenamed("n", "peer_n").filter(F.col("peer_n") >= least)
    return d.join(peers, key).withColumn("under", F.round(F.col("discount") - F.col("peer_median"), 6))

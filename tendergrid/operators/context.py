"""What the rules know about a contract's project, agency, pair, group, place and winner.

Each context is a small aggregate of its own key, joined back: partial aggregation runs before the shuffle, and the
optimiser broadcasts a side where its size permits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parse import haversine_km
from ..functions.stats import beta_survival, quantiles, with_posterior
from ..functions.values import SPECIFIC_METHOD
from ..tables import written

CEILING = 500_000


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def _of_projects() -> dict[str, Column]:
    return {"p_n": F.count("*"), "p_sum": F.sum("contract_price_agree"), "p_missing": F.count_if(F.col("contract_price_agree").isNull())}


def _total() -> Column:
    return F.when((F.col("p_missing") == 0) & (F.col("p_sum") > 0), F.col("p_sum"))


def projects(c: DataFrame) -> DataFrame:
    """Contracts, their sum, and how many have no price, per project; total is null unless all have and it is positive."""
    return c.groupBy("project_id").agg(*[v.alias(k) for k, v in _of_projects().items()]).withColumn("p_total", _total())


def with_projects(c: DataFrame) -> DataFrame:
    """c with p_n, p_sum and p_missing of its projects, for a table whose projects lie together and are small. joined_projects()
    reads them there, so rows that are filtered afterwards must drop them first."""
    own = W.partitionBy("project_id")
    return c.withColumns({k: F.when(F.col("project_id").isNotNull(), v.over(own)) for k, v in _of_projects().items()})


def joined_projects(c: DataFrame) -> DataFrame:
    """c with what projects() tells; nothing is aggregated or joined where with_projects() has told it."""
    if set(_of_projects()) <= set(c.columns):
        return c.withColumn("p_total", _total())
    return c.join(projects(c), "project_id", "left")


def dealings(c: DataFrame) -> DataFrame:
    """Contracts and their value per agency, winner and tax number; pairs, winners and identities take it in place of c."""
    own = c.groupBy("dept_key", "winner_key", "winner_tin", "tin_is_masked")
    return written(own.agg(F.count("*").alias("n_dealings"), F.sum("contract_price_agree").alias("contract_price_agree")))


def _rows(c: DataFrame) -> Column:
    return F.sum("n_dealings") if "n_dealings" in c.columns else F.count("*")


def pairs(c: DataFrame) -> DataFrame:
    return c.groupBy("dept_key", "winner_key").agg(_rows(c).alias("pair_n"), F.sum("contract_price_agree").alias("pair_value"))


def same_day_groups(c: DataFrame) -> DataFrame:
    """Contracts of one agency and winner on one day."""
    dated = c.filter(F.col("contract_date").isNotNull()).groupBy("dept_key", "winner_key", "contract_date")
    price = F.col("contract_price_agree")
    return dated.agg(F.count("*").alias("g_n"), F.count(price).alias("g_priced"), F.sum(price).alias("g_total"), F.max(price).alias("g_max"), F.count_distinct("project_id").alias("g_projects"))


def with_same_day_groups(c: DataFrame) -> DataFrame:
    """c with what same_day_groups() tells of each contract's group; null where the agency, winner or day is null. Contracts
    are dealt once, by group or by what they are dealt by already, and no row is joined."""
    key = ["dept_key", "winner_key", "contract_date"]
    price, own = F.col("contract_price_agree"), W.partitionBy(*key)
    known = F.col(key[0]).isNotNull() & F.col(key[1]).isNotNull() & F.col(key[2]).isNotNull()
    sums = {"g_n": F.count("*"), "g_priced": F.count(price), "g_total": F.sum(price), "g_max": F.max(price)}
    # Projects of a group are numbered in order, those without an id, which don't count, first.
    out = c.withColumn("_project", F.dense_rank().over(own.orderBy(F.col("project_id").asc_nulls_first())))
    distinct = F.max("_project").over(own) - F.max(F.col("project_id").isNull().cast("long")).over(own)
    return out.withColumns({k: F.when(known, v) for k, v in ({k: v.over(own) for k, v in sums.items()} | {"g_projects": distinct}).items()}).drop("_project")


def winners(c: DataFrame) -> DataFrame:
    return c.groupBy("winner_key").agg(_rows(c).alias("w_n"), F.count_distinct(F.when(_present("dept_key"), F.col("dept_key"))).alias("w_depts"), F.sum("contract_price_agree").alias("w_value"))


def identities(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names per tax number, and numbers per name; masked and blank ones don't count."""
    known = c.filter(~F.col("tin_is_masked") & _present("winner_tin") & _present("winner_key"))
    return known.groupBy("winner_tin").agg(F.count_distinct("winner_key").alias("tin_names")), known.groupBy("winner_key").agg(F.count_distinct("winner_tin").alias("name_tins"))


def repeated_numbers(c: DataFrame) -> DataFrame:
    return c.filter(_present("contract_no")).groupBy("dept_key", "contract_no").agg(F.count("*").alias("no_n"))


def agency_methods(c: DataFrame, ceiling: float = CEILING) -> DataFrame:
    """Projects above the ceiling and those bought directly, per agency; a project's first contract fixes its method."""
    first = F.min_by("purchase_method_name", F.struct("contract_date", "contract_no", "purchase_method_name"))
    own = c.filter(F.col("project_money") > ceiling).groupBy("dept_key", "project_id").agg(first.alias("method"))
    return own.groupBy("dept_key").agg(F.count("*").alias("a_projects"), F.count_if(F.col("method") == SPECIFIC_METHOD).alias("a_specific"))


def agency_direct_share(c: DataFrame, share: float, ceiling: float = CEILING) -> DataFrame:
    """The posterior chance that an agency buys more than this share of its large projects directly."""
    groups = with_posterior(agency_methods(c, ceiling), "a_specific", "a_projects")
    return groups.select("dept_key", "a_projects", "a_specific", beta_survival(F.lit(share), F.col("alpha"), F.col("beta")).alias("a_confidence"))


def centroids(c: DataFrame, least: int = 3) -> DataFrame:
    placed = c.filter((F.col("geo_quality") == "ok") & F.col("lat").isNotNull())
    lat, lon = quantiles(placed, "lat", ["province"], {"c_lat": 0.5}), quantiles(placed, "lon", ["province"], {"c_lon": 0.5}).drop("n")
    return lat.filter(F.col("n") >= least).drop("n").join(lon, "province")


def agency_distances(c: DataFrame, least: int = 3) -> DataFrame:
    """Median distance of an agency's contracts to their provinces' centroids."""
    placed = c.filter((F.col("geo_quality") == "ok") & F.col("lat").isNotNull()).join(centroids(c), "province")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    return quantiles(placed.select("dept_key", km.alias("km")), "km", ["dept_key"], {"d_median_km": 0.5}).filter(F.col("n") >= least).drop("n")


def regional_cells(c: DataFrame, gap_points: float) -> DataFrame:
    """Per type and province: the posterior chance that contracts at exactly the reference price are more common by a gap."""
    priced = joined_projects(c).withColumn("ratio", F.col("p_total").cast("double") / F.col("price_build").cast("double"))
    priced = priced.filter((F.col("ratio") > 0) & (F.col("ratio") <= 3) & _present("province"))
    exact = F.count_if(F.abs(F.col("ratio") - 1) < 1e-6)
    cells = priced.groupBy("project_type_name", "province").agg(F.count("*").alias("r_n"), exact.alias("r_exact"))
    types = cells.groupBy("project_type_name").agg(F.sum("r_n").alias("t_n"), F.sum("r_exact").alias("t_exact"), F.count("*").alias("t_cells")).filter((F.col("t_n") >= 20) & (F.col("t_cells") >= 5))
    groups = with_posterior(cells.join(types, "project_type_name"), "r_exact", "r_n", ["project_type_name"])
    bar = F.col("t_exact") / F.col("t_n") + gap_points / 100
    return groups.withColumn("r_confidence", F.when(bar < 1, beta_survival(bar, F.col("alpha"), F.col("beta")))).select("project_type_name", "province", "r_n", "r_exact", "r_confidence")

"""The contract view: procurement columns projected from the order tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import EBIDDING_METHOD, SPECIFIC_METHOD
from ..operators import context
from ..tables import written_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contracts(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One contract per line of an order; columns that a query doesn't use are pruned from the scans. dealt: contracts of a
    project lie together, dealt evenly to tasks however few row groups the input has."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    # Agencies meet their orders, and suppliers and parts their lines, while both are narrow; what is joined last is dealt by order.
    placed = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    )
    sold = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(part, line.l_partkey == part.p_partkey)
    joined = (sold.repartition("l_orderkey") if dealt else sold).join(placed, line.l_orderkey == orders.o_orderkey)
    method = F.when(F.col("o_orderpriority") == "5-LOW", SPECIFIC_METHOD).when(F.col("o_orderpriority") == "1-URGENT", EBIDDING_METHOD).otherwise(F.col("o_orderpriority"))
    start, finish = F.to_date("l_shipdate"), F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int") - 10)
    return joined.select(
        F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("contract_no"), F.col("n_name").alias("dept_key"), F.col("c_custkey").alias("dept_sub_name"),
        F.col("r_name").alias("province"), F.col("l_suppkey").alias("winner_key"), F.concat(F.lit("T"), F.col("l_suppkey") % 90).alias("winner_tin"), F.lit(False).alias("tin_is_masked"),
        (money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)").alias("contract_price_agree"), money("l_extendedprice").alias("price_build"),
        money("o_totalprice").alias("project_money"), (money("o_totalprice") / 2).cast("decimal(18,2)").alias("sum_price_agree"), F.to_date("o_orderdate").alias("announce_date"), start.alias("contract_date"),
        finish.alias("contract_finish_date"), F.datediff(finish, start).alias("duration_days"), F.datediff(start, F.to_date("o_orderdate")).alias("announce_gap_days"),
        method.alias("purchase_method_name"), F.col("p_type").alias("project_type_name"), F.col("p_name").alias("project_name"),
        (5 + (F.col("c_custkey") * 37 % 1600) / 100).alias("lat"), (96 + (F.col("l_suppkey") * 53 % 1000) / 100).alias("lon"), F.when(F.col("c_custkey") % 7 == 0, "shared").otherwise("ok").alias("geo_quality"),
    )


def viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view without project names, with what context.projects() tells of each project, written once a session: rules and
    their contexts read it column by column."""
    return written_once(context.with_projects(contracts(spark, sf_dir, dealt=True).drop("project_name")), "contracts")


#: The same view for DuckDB, to stand before a query.
K = f"""WITH k AS (SELECT l_orderkey AS project_id, l_linenumber AS contract_no, n_name AS dept_key, c_custkey AS dept_sub_name, r_name AS province,
l_suppkey AS winner_key, 'T' || (l_suppkey % 90) AS winner_tin, false AS tin_is_masked,
CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS contract_price_agree,
CAST(l_extendedprice AS DECIMAL(18,2)) AS price_build, CAST(o_totalprice AS DECIMAL(18,2)) AS project_money,
CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.5 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) AS sum_price_agree,
CAST(o_orderdate AS DATE) AS announce_date, CAST(l_shipdate AS DATE) AS contract_date, CAST(l_shipdate AS DATE) + (CAST(l_quantity AS INTEGER) - 10) AS contract_finish_date,
CAST(l_quantity AS INTEGER) - 10 AS duration_days, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS announce_gap_days,
CASE o_orderpriority WHEN '5-LOW' THEN '{SPECIFIC_METHOD}' WHEN '1-URGENT' THEN '{EBIDDING_METHOD}' ELSE o_orderpriority END AS purchase_method_name,
p_type AS project_type_name, p_name AS project_name, 5 + (c_custkey * 37 % 1600) / 100.0::DOUBLE AS lat, 96 + (l_suppkey * 53 % 1000) / 100.0::DOUBLE AS lon,
CASE WHEN c_custkey % 7 = 0 THEN 'shared' ELSE 'ok' END AS geo_quality
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""

"""Small registries in the shared storage: entries by key, and data sets with one in use.

A registry is a Parquet folder of changes to which rows are only ever added, so nothing is lost if a writer dies: of each
key the latest change counts, and a change without a value takes the key away. One writer at a time. What reaches the
driver is the entries, never the data that they stand for.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "version long, key string, value string"
ACTIVE = "active"


def _changes(spark: SparkSession, path: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(SCHEMA).parquet(path) if known else spark.createDataFrame([], SCHEMA)


def history(spark: SparkSession, path: str) -> DataFrame:
    """All changes in order; a null value took the key away."""
    return _changes(spark, path).orderBy("version", "key")


def entries(spark: SparkSession, path: str) -> dict[str, str]:
    """The value of each key that stands."""
    latest = _changes(spark, path).groupBy("key").agg(F.max_by(F.struct("value"), "version").alias("last"))
    return {r["key"]: r["value"] for r in latest.select("key", "last.value").filter("value is not null").orderBy("key").collect()}


def put(spark: SparkSession, path: str, changes: dict[str, str | None]) -> int:
    """Adds changes as one version and returns its number."""
    version = (_changes(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    spark.createDataFrame([(version, k, v) for k, v in changes.items()], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return version


def save_dataset(spark: SparkSession, path: str, c: DataFrame, name: str) -> str:
    """Writes contracts as a data set of the registry at path and returns its id; what list_datasets() tells of it is
    counted from the written table."""
    dataset = f"ds_{sum(k.startswith('ds_') for k in {r[0] for r in _changes(spark, path).select('key').distinct().collect()}) + 1}"
    table = f"{path.rstrip('/')}-data/{dataset}"
    c.write.mode("errorifexists").parquet(table)
    told = spark.read.parquet(table).agg(
        F.count("*").alias("n_records"), F.coalesce(F.sum("contract_price_agree").cast("double"), F.lit(0.0)).alias("total_contract_value"), F.min("contract_date").cast("string").alias("contract_date_min"),
        F.max("contract_date").cast("string").alias("contract_date_max"), F.count_distinct("dept_key").alias("n_agencies"), F.count_distinct("winner_key").alias("n_contractors"),
        F.coalesce(F.round(100 * F.count("lat") / F.nullif(F.count("*"), F.lit(0)), 1), F.lit(0.0)).alias("geo_pct"),
    ).first().asDict()
    put(spark, path, {dataset: json.dumps({"name": name, "table": table, **told}, ensure_ascii=False)})
    return dataset


def list_datasets(spark: SparkSession, path: str) -> dict[str, dict]:
    """What is known of each data set, the latest first."""
    found = {k: json.loads(v) for k, v in entries(spark, path).items() if k != ACTIVE}
    return dict(sorted(found.items(), key=lambda kv: -int(kv[0][3:])))


def rename_dataset(spark: SparkSession, path: str, dataset: str, name: str) -> None:
    put(spark, path, {dataset: json.dumps(list_datasets(spark, path)[dataset] | {"name": name}, ensure_ascii=False)})


def activate(spark: SparkSession, path: str, dataset: str | None) -> None:
    """Makes the data set the one in use; None goes back to the base table."""
    if dataset is not None and dataset not in list_datasets(spark, path):
        raise ValueError(f"no data set {dataset}")
    put(spark, path, {ACTIVE: dataset})


def active(spark: SparkSession, path: str) -> str | None:
    return entries(spark, path).get(ACTIVE)


def read_active(spark: SparkSession, path: str, base: DataFrame) -> DataFrame:
    """The data set in use, base where none is."""
    found = active(spark, path)
    return base if found is None else spark.read.parquet(list_datasets(spark, path)[found]["table"])


def remove_dataset(spark: SparkSession, path: str, dataset: str) -> None:
    """Takes the data set out of the registry, then deletes its table; if it was in use, none is."""
    table = list_datasets(spark, path)[dataset]["table"]
    put(spark, path, {dataset: None} | ({ACTIVE: None} if active(spark, path) == dataset else {}))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

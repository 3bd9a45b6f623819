"""Sessions for tests and benchmarks; on a cluster the caller brings a session of its own."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(name: str, cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings that results depend on: UTC, and AQE for the runtime plan."""
    # Workers start afresh and must find this package wherever the driver was started.
    here = str(Path(__file__).resolve().parent.parent)
    found = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if here not in found:
        os.environ["PYTHONPATH"] = os.pathsep.join([here, *filter(None, found)])
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

"""Tables that an operator writes once to the folder that driver and executors share, and reads again."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and all runs in one process."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Tables written by this process and not released yet, and views written once for all queries of a session.
_WRITTEN: list[tuple[SparkSession, str]] = []
_ONCE: dict[tuple, DataFrame] = {}


def written(df: DataFrame, split_mb: int | None = None, wide: bool = False) -> DataFrame:
    """df as a Parquet table of the shared folder: lineage ends there, and later passes read the columns they need. split_mb
    bounds its row groups, so that passes that cost much a row are shared by more tasks than the files are many. wide: whole
    rows were shuffled for it, whose files go now."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.size", split_mb << 20) if split_mb else writer).parquet(path)
    _WRITTEN.append((df.sparkSession, path))
    if wide:
        # Spark deletes a shuffle's files when the driver collects what refers to it, and disks fill long before its memory.
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(spark: SparkSession) -> str:
    """A new folder's name in the shared folder, deleted with the tables."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written_once(df: DataFrame, name: str) -> DataFrame:
    """df written the first time that this session asks for `name` over these input files; the same table after that."""
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, name, tuple(sorted(df.inputFiles())))
    if key not in _ONCE:
        _ONCE[key] = written(df, split_mb=16, wide=True)
    return _ONCE[key]


def release(spark: SparkSession) -> None:
    """Deletes the tables that this process has written for the session. DataFrames that read them end with it: call it
    once their rows are saved. What is left goes when the process ends."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for owner, name in list(_WRITTEN):
        if owner is spark:
            path = path_of(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _WRITTEN.remove((owner, name))
    for key in [k for k in _ONCE if k[0] == spark.sparkContext.applicationId]:
        del _ONCE[key]


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _WRITTEN}.values():
        if spark.sparkContext._jsc is not None:
            release(spark)

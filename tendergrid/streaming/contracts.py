"""Contracts as a stream: windows of late events, and upserts batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import upsert


def window_counts(events: DataFrame, key: str, time: str = "ts", width: str = "30 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of a key per sliding window; rows later than `late` behind the newest are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: tuple[str, ...], order: str):
    """Starts a query that merges each batch into the Parquet table at path/<version>; the newest version counts.

    Rows carry their own order: an older event of a later batch changes nothing. A batch that is run again writes the
    same version again, so the table is the same after a restart.
    """
    spark = stream.sparkSession

    def merge_batch(batch: DataFrame, number: int) -> None:
        before = f"{path}/v={number - 1}"
        base = spark.read.parquet(before) if number else batch.limit(0)
        upsert(base, batch, key, order).drop("merge_kind").write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

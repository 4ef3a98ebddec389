"""Streams of status records: windowed counts with a watermark, and upserts into a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import latest


def status_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by event-time window and type; later rows than the watermark are dropped by the engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def upsert_stream(events: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Keep the latest row of each key: every batch is merged with the table of the batch before and written as a new version, so a repeated batch gives the same version."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, [F.desc(order)])
        if epoch:
            new = latest(spark.read.parquet(f"{path}/v={epoch - 1}").unionByName(new), keys, [F.desc(order)])
        new.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_version(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v={epoch}")

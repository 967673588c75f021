"""Structured Streaming: log ingestion with retention, deliveries merged as they come, and windowed counts (an extension)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import mutate
from ..sources.sinks import Versions


def ingest_logs(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append new log files to a Parquet table, then stop."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def retained(logs: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Rows younger than days, at most 90."""
    return logs.where(F.col("ts") >= now - F.make_interval(days=F.lit(min(days, 90))))


def deliver(spark: SparkSession, source: str, schema: str, store: Versions, table: str, keys: list[str], mode: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of late rows is merged into the table's ACTIVE rows under a mode and committed as a version.

    Rows of other statuses are history and stay as they are. A version notes the last batch of each stream, by its checkpoint
    folder, so a batch that runs again after a failure changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = store.notes()
        if done.get(checkpoint, -1) >= number:
            return
        every = store.read(table)
        live = every.where("record_status = 'ACTIVE'").drop("record_status")
        history = every.where("record_status is distinct from 'ACTIVE'")
        store.commit({table: mutate(live, df, keys, mode).unionByName(history)}, notes=done | {checkpoint: number})

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(logs: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by window and action; works on streams, dropping rows later than the watermark."""
    w = F.window("ts", size)
    return logs.withWatermark("ts", late).groupBy(w, "action").agg(F.count("*").alias("events"), F.sum("value").alias("value"))

"""Stateful streams over event files: context counts, and windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_path, table


def drained(spark: SparkSession, stream: DataFrame, name: str, keys: list[str], by: str) -> DataFrame:
    """What a stream has given when all its input is read; sink and checkpoint are in the shared folder.

    In update mode a batch writes only the groups that it changed, and state behind the watermark is dropped; of a group's
    rows the one of the largest count is the last.
    """
    out = shared_path(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")  # a batch that is tried again replaces its own rows

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/data").drop("batch")
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(by, *[c for c in values if c != by])).alias("last")).select(*keys, *[F.col(f"last.{c}").alias(c) for c in values])


def source(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_context_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by type: a state of as many rows as there are types."""
    counts = source(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("bigint")).alias("n1"))
    return drained(spark, counts, "stream-counts", ["event_type"], "n")


def hourly(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events by hour. State is dropped when the watermark has passed an hour; events later than that are not counted."""
    counts = rows.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return drained(spark, hourly(source(spark, sf)), "stream-hours", ["hour", "event_type"], "n")


def sessions(rows: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """A user's sessions: events no further apart than gap."""
    counts = rows.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


def stream_hopping(spark: SparkSession, sf: str) -> DataFrame:
    """Events by windows of six hours that begin every two."""
    counts = source(spark, sf).withWatermark("ts", "1 day").groupBy(F.window("ts", "6 hours", "2 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return drained(spark, counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n"), "stream-hops", ["start", "event_type"], "n")


def batch_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The same sessions over a table: by number of events."""
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(rows).groupBy("n").agg(F.count("*").alias("n_sessions")).select(F.col("n").alias("n_events"), "n_sessions")

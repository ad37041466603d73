"""Streaming versions of three batch operators. An extension: the batch operators are the ones to compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of Parquet files; event time as a timestamp with a zone, as watermarks need it."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def rolling_metrics(events: DataFrame, by: list[str], value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and mean in tumbling windows; rows later than ``late`` behind the newest are dropped and state is let go."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), *by)
    return w.agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean")).select(F.col("w.start").alias("start"), *by, "n", "mean")


def posting_counts(events: DataFrame, key: str) -> DataFrame:
    """Growing lengths of posting lists (complete or update mode)."""
    return events.groupBy(key).agg(F.count("*").alias("n"))


def first_within(events: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """Each key once within the watermark's span."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def latest(events: DataFrame, key: str) -> DataFrame:
    """The last record of each key by event time (complete or update mode)."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), "ts").alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process what there is, then return the result (for tests and backfills)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)

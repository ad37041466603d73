"""Streams over the given tables, run to the end of what there is: each equals its batch operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.sources.writers import own_folder
from lakeweave.streaming import incremental, keyed

from .registry import query


def _stream(df, files: int):
    """``df`` as a stream of a few files, taken one batch after another."""
    spark = df.sparkSession
    path = own_folder(spark, "in-")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("""SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id DESC) = 1""")
def stream_last_wins(t):
    rows = t("events").select(F.col("user_id").alias("key"), (F.col("event_id") % 4).alias("first"), F.col("event_id").alias("second"), "value")
    out = keyed.run_to_table(keyed.last_wins(_stream(rows, 4)), ["key"])
    return out.select(F.col("key").alias("user_id"), F.col("second").alias("event_id"), "value")


@query("""WITH w AS (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM benchmark)
SELECT w, count(DISTINCT item_id) AS df, count(*) AS ctf FROM w WHERE w <> '' GROUP BY w""")
def stream_postings(t):
    words = t("benchmark").select(F.col("item_id").cast("long").alias("did"), F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("w")).filter("w <> ''").withColumn("tf", F.lit(1).cast("long"))
    out = keyed.run_to_table(keyed.postings(_stream(words, 4)), ["w", "part"])
    return out.groupBy("w").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def stream_rolling_metrics(t):
    """Tumbling days; nothing here is later than the watermark allows."""
    events = _stream(t("events").withColumn("ts", F.col("ts").cast("timestamp")), 1)
    out = keyed.run_to_table(incremental.rolling_metrics(events, ["event_type"], "value", late="3650 days"), ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")

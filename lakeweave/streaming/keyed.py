"""Keyed state of our own in Structured Streaming: the last record of each key, and posting lists.

Both keep what a batch operator would compute from all rows so far, and equal it after every batch. State lies in RocksDB on the executors
and in the checkpoint, so a lost executor costs a replay of the last batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lakeweave.sources.writers import own_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = 16  # a word's list is kept in so many parts, dealt by document, so that a common word is no single task


class LastWins(StatefulProcessor):
    """The largest (order, value) of each key, whatever the order in which rows come.

    With ``quiet_ms`` a key whose watermark has passed its last change by so much is let go, and is told once more with ``closed``.
    """

    def __init__(self, quiet_ms: int | None = None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "first long, second long, value double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.last.get() if self.last.exists() else None
        best = old
        for r in rows:
            if best is None or (r.first, r.second) > tuple(best[:2]):
                best = (r.first, r.second, r.value)
        if best is not old:
            self.last.update(tuple(best))
            if self.quiet_ms is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.quiet_ms)
        yield Row(key=key[0], first=best[0], second=best[1], value=best[2], closed=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            x = self.last.get()
            self.last.clear()
            yield Row(key=key[0], first=x[0], second=x[1], value=x[2], closed=True)

    def close(self) -> None:
        pass


class Postings(StatefulProcessor):
    """For a word and a part: how often each document has it, and the length of the list so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.docs = handle.getMapState("docs", "did long", "tf long")
        self.size = handle.getValueState("size", "df long, ctf long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        df, ctf = self.size.get() if self.size.exists() else (0, 0)
        for r in rows:
            had = self.docs.getValue((r.did,))[0] if self.docs.containsKey((r.did,)) else 0
            self.docs.updateValue((r.did,), (had + r.tf,))
            df, ctf = df + (had == 0), ctf + r.tf
        self.size.update((df, ctf))
        yield Row(w=key[0], part=key[1], df=df, ctf=ctf)

    def close(self) -> None:
        pass


def last_wins(rows: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """A stream of (key, first, second, value) to the last of each key by (first, second) so far; with ``quiet_ms`` rows need a watermark."""
    kind = rows.schema["key"].dataType.simpleString()
    state = rows.groupBy("key").transformWithState(LastWins(quiet_ms), f"key {kind}, first long, second long, value double, closed boolean", "Update", "EventTime" if quiet_ms is not None else "None")
    return state


def postings(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """A stream of (did, w, tf) to document and collection frequencies of each word and part so far."""
    dealt = words.select("did", "w", F.col("tf").cast("long").alias("tf"), F.pmod(F.xxhash64("did"), F.lit(parts)).cast("int").alias("part"))
    return dealt.groupBy("w", "part").transformWithState(Postings(), "w string, part int, df long, ctf long", "Update", "None")


def run_to_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """Process what there is; of each key the row of the last batch that told of it. Batches are written to the shared folder.

    A batch that runs again after a failure writes over its own part.
    """
    spark = df.sparkSession
    path = own_folder(spark, "stream-")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        q = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    told = spark.read.schema(df.schema.add("batch", "long")).option("basePath", f"{path}/out").parquet(f"{path}/out/batch=*")
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return told.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "batch")

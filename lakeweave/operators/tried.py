"""Which items, say programs, were tried in earlier rounds: a Bloom filter with an exact table behind it.

The filter is a table of (slot, bits) with one row for each 64-bit word that has a bit set; an item has its bits in one word. It is
built by ``bit_or``, which adds up in each task before the shuffle, and two filters of the same number of slots merge by the same
aggregate. Items with a bit missing are new for certain and pass; only the others meet the exact table by an anti join, so no item is
taken for tried that is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.sources.writers import checkpoint_dir

PROBES = 4


def slot(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots).cast("long"))


def mask(key: Column) -> Column:
    """The item's bits within its word."""
    h = F.xxhash64(key, F.lit(1))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return reduce(lambda a, b: a.bitwiseOR(b), [one(i) for i in range(PROBES)])


def bloom(items: DataFrame, key: str, slots: int) -> DataFrame:
    return items.select(slot(F.col(key), slots).alias("slot"), mask(F.col(key)).alias("bits")).groupBy("slot").agg(F.bit_or("bits").alias("bits"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("slot").agg(F.bit_or("bits").alias("bits"))


class Tried:
    """What was tried so far. ``expected`` items, each of ``bits`` bits, set the size; more items only send more rows to the exact join."""

    def __init__(self, spark, kind: str, expected: int = 10_000, bits: int = 40):
        checkpoint_dir(spark)
        self.slots = max(1, -(-expected * bits // 64))
        self.filter = spark.createDataFrame([], "slot long, bits long")
        self.exact = spark.createDataFrame([], f"key {kind}")

    def marked(self, items: DataFrame, key: str) -> DataFrame:
        """``items`` with ``_maybe``: whether the filter has all bits of the key."""
        own = items.withColumn("_slot", slot(F.col(key), self.slots)).withColumn("_mask", mask(F.col(key)))
        held = self.filter.select(F.col("slot").alias("_slot"), F.col("bits").alias("_bits"))
        return own.join(held, "_slot", "left").withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))).drop("_slot", "_mask", "_bits")

    def new(self, items: DataFrame, key: str) -> DataFrame:
        """The items that were not tried."""
        seen = self.marked(items, key)
        doubtful = seen.filter("_maybe").join(self.exact.select(F.col("key").alias(key)), key, "left_anti")
        return seen.filter("not _maybe").unionByName(doubtful.select(*seen.columns)).drop("_maybe")

    def save(self, items: DataFrame, key: str) -> None:
        """Add items that ``new`` has let pass."""
        keys = items.select(F.col(key).alias("key")).distinct().checkpoint()
        self.filter = merged(self.filter, bloom(keys, "key", self.slots)).checkpoint()
        self.exact = self.exact.unionByName(keys)


def rounds(proposals: DataFrame, round_col: str, key: str, expected: int = 10_000) -> DataFrame:
    """Round by round: (round, proposed, tried, new), the rows proposed, those among them tried in an earlier round, and the distinct new keys."""
    tried = Tried(proposals.sparkSession, proposals.schema[key].dataType.simpleString(), expected)
    proposals, out = proposals.select(round_col, key).checkpoint(), None
    for r in sorted(x[0] for x in proposals.select(round_col).distinct().collect()):
        own = proposals.filter(F.col(round_col) == F.lit(r))
        fresh = tried.new(own, key).checkpoint()
        counts = own.agg(F.count("*").alias("proposed")).join(fresh.agg(F.count("*").alias("_f"), F.countDistinct(key).alias("new")))
        row = counts.select(F.lit(r).alias("round"), "proposed", (F.col("proposed") - F.col("_f")).alias("tried"), "new")
        out = row if out is None else out.unionByName(row)
        tried.save(fresh, key)
    return out

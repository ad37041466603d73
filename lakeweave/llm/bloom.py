"""A blocked Bloom filter over 64-bit hashes, in DataFrame functions alone.

The filter is a table of blocks (block, map) of BLOCK_BITS bits each, as many as BITS_PER_ROW bits a row ask for, and never
over MAX_BITS bits, the bound up to which it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ROW, MAX_BITS, PROBES = 24, 1 << 29, 3
BLOCK_BITS = 32_768  # what one value of bitmap_construct_agg holds


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.col(key), F.lit(blocks)).cast("int")


def bits_of(key: str) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(BLOCK_BITS)).cast("int") for i in range(PROBES)])


def filter_of(rows: DataFrame, key: str, times: int = 1, max_bits: int = MAX_BITS, count: int | None = None) -> tuple[DataFrame, int]:
    """The filter of the hashes in ``key``, holding the bits that ``times`` rows or more set; and its number of blocks."""
    blocks = max(1, min(max_bits, (rows.count() if count is None else count) * BITS_PER_ROW) // BLOCK_BITS)
    bits = rows.select(block_of(key, blocks).alias("_block"), F.explode(F.array_distinct(bits_of(key))).alias("_bit"))
    if times > 1:
        bits = bits.groupBy("_block", "_bit").agg(F.count("*").alias("_n")).filter(F.col("_n") >= times)
    return bits.groupBy("_block").agg(F.bitmap_construct_agg(F.col("_bit").cast("long")).alias("_map")), blocks


def marked(rows: DataFrame, bloom: tuple[DataFrame, int], key: str, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false only where the filter surely lacks the hash."""
    maps, blocks = bloom
    out = rows.withColumn("_block", block_of(key, blocks)).withColumn("_bits", bits_of(key)).join(F.broadcast(maps), "_block", "left")
    test = F.col("_map").isNotNull()
    for i in range(PROBES):
        byte = F.conv(F.hex(F.substring(F.col("_map"), F.expr(f"(_bits[{i}] div 8) + 1"), F.lit(1))), 16, 10).cast("int")
        test = test & (F.getbit(byte, F.expr(f"_bits[{i}] % 8").cast("int")) == 1)
    return out.withColumn(name, F.coalesce(test, F.lit(False))).drop("_block", "_bits", "_map")


def contained(rows: DataFrame, bloom: tuple[DataFrame, int], key: str) -> DataFrame:
    return marked(rows, bloom, key, "_there").filter("_there").drop("_there")

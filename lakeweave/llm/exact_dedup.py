"""Exact dedup by two passes over a blocked Bloom filter, in DataFrame functions alone.

Pass 1 maps the hash of every text to a block of the filter and to PROBES bit positions in it, and keeps the
positions that were set twice or more. Pass 2 probes: a row whose positions were all set twice is possibly repeated, and
only such rows are shuffled by their text's digest; all other rows pass straight through.

Rows of a text that stands in many documents are joined with their group by a broadcast of such groups, the others by a shuffle.
To build the filter, three small rows (block, bit) a document are shuffled, and no texts or digests.

The filter has BITS_PER_ROW bits a row up to MAX_BITS. It is broadcast only within that bound (MAX_BITS / 8 bytes); in a
larger table it fills up, more rows take the shuffled way, and the result stays the same.

Defined cases: a null text is the empty text; null doc_ids count as smaller than all others; of rows with the same
doc_id and text one is kept; texts of any length are hashed whole; an empty table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import by_key, documents, stash
from .bloom import MAX_BITS, filter_of, marked


def possibly_repeated(hashed: DataFrame, key: str = "_h", max_bits: int = MAX_BITS) -> DataFrame:
    """``hashed`` with a boolean column ``_twice``: false only where no other row has the same ``key``."""
    return marked(hashed, filter_of(hashed, key, times=2, max_bits=max_bits), key, "_twice")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. Of equal texts the row with the largest id stays."""
    sha = F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256)
    own = stash(docs.select(F.col(id_col).alias("_id"), F.unhex(sha).alias("_sha"), F.monotonically_increasing_id().alias("_row")))
    own = possibly_repeated(own.withColumn("_h", F.xxhash64("_sha")), max_bits=max_bits)
    row = F.struct(F.col("_id"), F.col("_row"))
    alone = own.filter("not _twice").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha")
    maybe = own.filter("_twice").select("_id", "_row", "_sha")
    groups = stash(maybe.groupBy("_sha").agg(F.max(row).alias("_last"), F.count("*").alias("group_size")))
    shared = by_key(maybe, groups, "_sha", "group_size").select("_id", F.col("_last._id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_last._row")).alias("kept"), "_sha")
    return alone.unionByName(shared).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

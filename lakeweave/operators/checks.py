"""Checks of vector records: a table of rules, and how many records, tables or columns break each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bad(v: Column) -> Column:
    """Whether an element is null, no number or infinite."""
    return F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


#: Rules on one record (table_id, column_key, v, size): true where it is broken.
RECORD = {
    "missing field": lambda: F.col("table_id").isNull() | F.col("column_key").isNull() | F.col("v").isNull(),
    "key is no number": lambda: F.col("column_key").isNotNull() & F.col("column_key").try_cast("int").isNull(),
    "another size than stated": lambda: F.size("v") != F.col("size"),
    "empty vector": lambda: F.size("v") == 0,
    "null or infinite element": lambda: bad(F.col("v")),
}


def broken_records(records: DataFrame) -> DataFrame:
    """The records that break a rule, a row for each rule."""
    rules = F.array_compact(F.array(*[F.when(F.coalesce(test(), F.lit(False)), F.lit(name)) for name, test in RECORD.items()]))
    return records.withColumn("rule", F.explode(rules))


def check_records(records: DataFrame, tables: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(rule, n) for every rule, 0 where it holds.

    Beside the rules on single records: records of the same table and column, tables whose vectors have several sizes, tables that
    should be there and are not and the reverse (``tables``: table_id), and the same for columns (``columns``: table_id, column_key).
    """
    single = broken_records(records).groupBy("rule").agg(F.count("*").alias("n"))
    count = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count("*").alias("n"))
    own, want = records.select("table_id").filter("table_id is not null").distinct(), tables.select("table_id").distinct()
    sizes = records.filter("v is not null").groupBy("table_id").agg(F.count_distinct(F.size("v")).alias("k"))
    parts = [
        count("repeated column", records.groupBy("table_id", "column_key").agg(F.count("*").alias("k")).filter("k > 1")),
        count("sizes mixed in a table", sizes.filter("k > 1")),
        count("missing table", want.join(own, "table_id", "left_anti")),
        count("extra table", own.join(want, "table_id", "left_anti")),
    ]
    if columns is not None:
        held = records.select("table_id", "column_key").distinct()
        parts.append(count("missing column", columns.select("table_id", "column_key").distinct().join(own, "table_id", "left_semi").join(held, ["table_id", "column_key"], "left_anti")))
    out = single
    for p in parts:
        out = out.unionByName(p)
    names = list(RECORD)
    every = records.sparkSession.createDataFrame([(n,) for n in names], "rule string")  # one row a rule
    none = every.join(single.select("rule"), "rule", "left_anti").select("rule", F.lit(0).cast("long").alias("n"))
    return out.unionByName(none)


def compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """(size, n_a, n_b): how many vectors of each size either side has; they can be compared where there is one size, and the same."""
    n = lambda df, name: df.filter("v is not null").groupBy(F.size("v").alias("size")).agg(F.count("*").alias(name))
    return n(a, "n_a").join(n(b, "n_b"), "size", "full").fillna(0)

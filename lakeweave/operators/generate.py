"""Synthetic tables and augmented copies. Every number is a hash of its cell, so that any partitioning gives the same table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .prepare import keyed


def uniform(seed: str, *keys: str | Column) -> Column:
    return (keyed(seed, *keys) + 0.5) / F.lit(2147483648.0)


def normal(seed: str, *keys: str | Column) -> Column:
    """Box-Muller from two uniform numbers."""
    return F.sqrt(-2 * F.log(uniform(f"{seed}:a", *keys))) * F.cos(2 * math.pi * uniform(f"{seed}:b", *keys))


def zipf(seed: str, n: int, *keys: str | Column) -> Column:
    """0 .. n-1 with weights 1 / (i + 1)."""
    total, at, u, out = sum(1 / i for i in range(1, n + 1)), 0.0, uniform(seed, *keys), None
    for i in range(n - 1):
        at += 1 / (i + 1) / total
        out = F.when(u < at, i) if out is None else out.when(u < at, i)
    return F.lit(0) if out is None else out.otherwise(n - 1)


def row_table(spark: SparkSession, rows: int, features: int, category_share: float = 0.25, cardinality: int = 10, missing: float = 0.0, seed: str = "rows") -> DataFrame:
    """Normal and Zipf-distributed features, a share of missing values, and a binary label."""
    n_cat = round(features * category_share)
    cols = []
    for i in range(features):
        x = F.concat(F.lit("c"), zipf(f"{seed}:{i}", cardinality, "row_idx")) if i < n_cat else normal(f"{seed}:{i}", "row_idx")
        cols.append(F.when(uniform(f"{seed}:miss:{i}", "row_idx") >= missing, x).alias(f"f{i}"))
    return spark.range(rows).withColumnRenamed("id", "row_idx").select("row_idx", *cols, (uniform(f"{seed}:y", "row_idx") < 0.5).cast("int").alias("label"))


def sweep(spark: SparkSession, base: dict[str, int], levels: dict[str, list[int]]) -> DataFrame:
    """One factor at a time: (id, factor, level, and all settings)."""
    rows = [(f"{f}_{v}", f, v, *[v if k == f else b for k, b in base.items()]) for f, vs in levels.items() for v in vs]
    return spark.createDataFrame(rows, "id string, factor string, level int, " + ", ".join(f"{k} int" for k in base))


def sweep_level(c: Column) -> Column:
    """struct(factor, level) back from an id."""
    return F.struct(F.regexp_extract(c, "^(.*)_([0-9]+)$", 1).alias("factor"), F.regexp_extract(c, "^(.*)_([0-9]+)$", 2).try_cast("int").alias("level"))


def random_vectors(df: DataFrame, key: str, vector: str, seed: str = "v") -> DataFrame:
    """Vectors of the same sizes with independent normal elements."""
    cells = df.select(key, F.size(vector).alias("_n"))
    return cells.select(key, F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: normal(seed, F.col(key).cast("string"), i.cast("string"))).cast("array<float>").alias(vector))


def augment(cells: DataFrame, how: str, percent: int = 20, seed: str = "aug") -> DataFrame:
    """One of the copies of a table in the cell model (table_id, row_idx, col, value)."""
    col_roll, row_roll, cell_roll = keyed(f"{seed}:c", "table_id", "col") % 100, keyed(f"{seed}:r", "table_id", "row_idx") % 100, keyed(f"{seed}:x", "table_id", "row_idx", "col")
    number = F.col("value").try_cast("double").isNotNull()
    if how == "drop_col":
        return cells.filter(col_roll >= percent)
    if how == "sample_row":
        return cells.filter(row_roll >= percent)
    if how == "drop_cell":
        return cells.withColumn("value", F.when(cell_roll % 100 >= percent, F.col("value")))
    if how == "drop_nan_col":
        some = cells.groupBy("table_id", "col").agg(F.count("value").alias("_n")).filter("_n > 0").select("table_id", "col")
        return cells.join(some, ["table_id", "col"], "left_semi").select(*cells.columns)
    if how == "drop_num_cell":
        return cells.withColumn("value", F.when(~(number & (cell_roll % 100 < percent)), F.col("value")))
    if how == "drop_num_col":
        text = cells.groupBy("table_id", "col").agg(F.count(F.when(number, 1)).alias("_x"), F.count("value").alias("_n")).filter("_x < _n or _n = 0").select("table_id", "col")
        return cells.join(text, ["table_id", "col"], "left_semi").select(*cells.columns)
    if how == "drop_head_cell":
        head = Window.partitionBy("table_id", "col").orderBy("row_idx")
        return cells.withColumn("_n", F.row_number().over(head)).withColumn("value", F.when((F.col("_n") > 5) | (cell_roll % 100 >= percent), F.col("value"))).drop("_n")
    if how in ("shuffle_row", "shuffle_col"):
        what = "row_idx" if how == "shuffle_row" else "col"
        old = cells.select("table_id", what).distinct()
        a = old.withColumn("_i", F.row_number().over(Window.partitionBy("table_id").orderBy(what)))
        b = old.withColumn("_i", F.row_number().over(Window.partitionBy("table_id").orderBy(keyed(f"{seed}:s", "table_id", what), what))).withColumnRenamed(what, "_new")
        order = a.join(b, ["table_id", "_i"]).drop("_i")
        return cells.join(order, ["table_id", what]).drop(what).withColumnRenamed("_new", what).select(*cells.columns)
    if how in ("replace_cell", "swap_cell"):
        rows = cells.groupBy("table_id").agg(F.max("row_idx").alias("_m"))
        src = cells.join(rows, "table_id").withColumn("_from", F.when(cell_roll % 100 < percent, F.floor(cell_roll / 100) % (F.col("_m") + 1)).otherwise(F.col("row_idx")))
        other = cells.select("table_id", F.col("row_idx").alias("_from"), "col", F.col("value").alias("_v"))
        return src.join(other, ["table_id", "_from", "col"], "left").withColumn("value", F.coalesce("_v", "value")).select(*cells.columns)
    raise ValueError(f"no such augmentation: {how}")

"""Places of values in an order, without a sort of all rows in one task.

Distinct values and their counts are dealt out by ranges; sums run within a range, and a range begins at the sum of those before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.sources.writers import checkpoint_dir


def counted(df: DataFrame, value: str, by: list[str] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """One row for each group and distinct known value: ``n`` rows have it, ``before`` have a lesser one; sums of ``extra`` likewise, as x and x_before."""
    checkpoint_dir(df.sparkSession)
    sums = {"n": F.count("*"), **{k: F.sum(c) for k, c in (extra or {}).items()}}
    rows = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(k) for k, c in sums.items()])
    rows = rows.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()).checkpoint()  # ranges are cut by a sample: they must not change
    upto = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = rows.groupBy(*by, "_range").agg(*[F.sum(k).alias(f"_{k}") for k in sums])
    over = Window.partitionBy(*by).orderBy("_range") if by else Window.orderBy("_range")  # one row a range
    whole = whole.select(*by, "_range", *[upto(f"_{k}", over).alias(f"_{k}") for k in sums])
    within = Window.partitionBy(*by, "_range").orderBy(value)
    rows = rows.select("*", *[upto(k, within).alias(f"_own_{k}") for k in sums]).join(whole, [*by, "_range"])
    name = lambda k: "before" if k == "n" else f"{k}_before"
    return rows.select(*by, value, *sums, *[(F.col(f"_own_{k}") + F.col(f"_{k}")).alias(name(k)) for k in sums])


def quantiles(ranked: DataFrame, value: str, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Of ``counted`` rows: exact quantiles of each group, between neighbours in proportion."""
    total = ranked.groupBy(*by).agg(F.sum("n").alias("_all"))
    x = ranked.join(total, list(by)) if by else ranked.join(total)  # without groups a single row
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value)))
    place = {k: (F.col("_all") - 1) * F.lit(float(p)) for k, p in shares.items()}
    ends = x.groupBy(*by).agg(F.max("_all").alias("_all"), *[f(at(g(p))).alias(f"_{e}_{k}") for k, p in place.items() for e, g, f in (("low", F.floor, lambda c: c), ("high", F.ceil, lambda c: c))])
    part = {k: p - F.floor(p) for k, p in place.items()}
    return ends.select(*by, *[(F.col(f"_low_{k}") + (F.col(f"_high_{k}") - F.col(f"_low_{k}")) * part[k]).alias(k) for k in shares])


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with the number (from 0, as ``name``) of rows that come before in the order; equal values have one number, rows without one go."""
    places = counted(df.select(F.col(order).alias("_order")), "_order").select(F.col("_order").alias(order), F.col("before").cast("long").alias(name))
    return df.join(places, order)


def placed(df: DataFrame, roll: str, ties: list[str], name: str, by: list[str] = ()) -> DataFrame:
    """``df`` with the place (from 0, as ``name``) of each row in its group by a number ``roll`` of 31 bits or so and ``ties``.

    Rows are sorted within cells of 2 ** 15 numbers, and a cell begins after the rows of those before: no group is one task. Rows already lie by cells
    when they are joined; left to its estimates, Spark may broadcast them.
    """
    x = df.withColumn("_cell", F.shiftright(F.col(roll).cast("long"), 15))
    n = x.groupBy(*by, "_cell").agg(F.count("*").alias("_c"))
    over = (Window.partitionBy(*by).orderBy("_cell") if by else Window.orderBy("_cell")).rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    n = n.select(*by, "_cell", F.coalesce(F.sum("_c").over(over), F.lit(0)).alias("_base"))
    x = x.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(roll, *ties)) - 1)
    return x.join(n.hint("merge"), [*by, "_cell"]).withColumn(name, F.col("_in") + F.col("_base")).drop("_cell", "_in", "_base")


def beside(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df``, computed, for a join with a table of cells or rows: broadcast if it has ``most`` rows or fewer, else shuffled.

    Spark chooses by sizes that it estimates from compressed files, and so may broadcast the larger table.
    """
    checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")

"""Preparation of tables for models: imputation, scaling, encoding, bins, splits, noise. Random choices are hashes of keys,
so that a row's fate depends neither on partitions nor on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.operators import ranks


def keyed(seed: str, *keys: str | Column) -> Column:
    """31 bits of md5 of the seed and the keys: the same number in any engine that has md5."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary")), 1, 8), 16, 10).cast("long") % 2147483648).cast("long")


def min_max(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Infinities and nulls become the median, then values are scaled to 0 .. 1; all figures come from ``fit_on``."""
    fit_on = df if fit_on is None else fit_on
    clean = lambda c: F.when(F.abs(F.col(c)) == float("inf"), F.lit(None)).otherwise(F.nanvl(F.col(c), F.lit(None).cast("double")))
    figures = fit_on.agg(*[f(clean(c)).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max), ("mid", F.median))]).first()
    out = {}
    for c in columns:
        low, high, mid = (figures[f"{n}_{c}"] for n in ("low", "high", "mid"))
        span = (high or 0.0) - (low or 0.0)
        x = F.coalesce(clean(c), F.lit(mid if mid is not None else 0.0))
        out[c] = F.round((x - F.lit(low or 0.0)) / F.lit(span), 6) if span else F.lit(0.0)
    return df.withColumns(out)


def ordinal(df: DataFrame, column: str, fit_on: DataFrame | None = None, unseen: int = -1) -> DataFrame:
    """Categories, as text and with null as 'nan', numbered in order; unseen ones get ``unseen``."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    seen = (df if fit_on is None else fit_on).select(text.alias("_c")).distinct()
    codes = ranks.numbered(seen, "_c", "_code")  # categories are dealt out by ranges: they are no single task
    return df.withColumn("_t", text).join(codes, F.col("_t") == F.col("_c"), "left").withColumn(column, F.coalesce("_code", F.lit(unseen)).cast("long")).drop("_t", "_c", "_code")


def quantile_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Right-closed quantile bins numbered from 0, or the distinct values themselves if there are fewer than ``bins``."""
    ranked = ranks.counted(df, column)
    distinct = [r[0] for r in ranked.select(column).orderBy(column).limit(bins).collect()]
    edges = distinct if len(distinct) < bins else list(ranks.quantiles(ranked, column, {f"q{i}": i / bins for i in range(1, bins)}).first())
    return df.withColumn("bin", sum(((F.col(column) > F.lit(float(e))).cast("int") for e in (edges[:-1] if len(distinct) < bins else edges)), F.lit(0)))


def hash_split(df: DataFrame, key: str, shares: dict[str, float], seed: str = "split") -> DataFrame:
    """Each distinct key in one split, by its hash: rows of a key stay together, and no sort of all keys is needed."""
    u, at, out = keyed(seed, key) / F.lit(2147483648.0), 0.0, None
    for name, share in shares.items():
        at += share
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return df.withColumn("split", out.otherwise(list(shares)[-1]))


def disjoint_pairs(pairs: DataFrame, a: str, b: str, shares: dict[str, float], seed: str = "split") -> DataFrame:
    """Pairs whose two tables fall into one split."""
    one = hash_split(pairs.withColumn("_k", F.col(a)), "_k", shares, seed).withColumnRenamed("split", "_s")
    return hash_split(one.withColumn("_k", F.col(b)), "_k", shares, seed).filter("split = _s").drop("_s", "_k")


def exact_split(df: DataFrame, key: str, shares: dict[str, int], seed: str = "split") -> DataFrame:
    """As many keys as ``shares`` says, in hash order."""
    ranked = ranks.placed(df.withColumn("_h", keyed(seed, key)), "_h", [key], "_r")
    at, out = 0, None
    for name, n in shares.items():
        at += n
        out = F.when(F.col("_r") < at, name) if out is None else out.when(F.col("_r") < at, name)
    return ranked.withColumn("split", out).drop("_h", "_r").filter(F.col("split").isNotNull())


#: In a hundred, renamed columns, spoilt cells and spoilt keys.
RENAMED, SPOILT, SPOILT_KEYS = 70, 5, 10


def renamed(name: Column, roll: Column) -> Column:
    """One of five ways to write a column's name otherwise: lower or upper case, blanks to _, _ to blanks, one blank at the end."""
    ways = [F.lower(name), F.upper(name), F.replace(name, F.lit(" "), F.lit("_")), F.replace(name, F.lit("_"), F.lit(" ")), F.concat(F.rtrim(name), F.lit(" "))]
    return F.element_at(F.array(*ways), (roll % 5 + 1).cast("int"))


def swapped(c: Column, roll: Column) -> Column:
    """Two neighbouring characters change places; a text of one stays as it is."""
    at = (roll % F.greatest(F.length(c) - 1, F.lit(1))).cast("int")
    cut = lambda start, n: F.substring(c, start, n)
    return F.when(F.length(c) < 2, c).otherwise(F.concat(cut(F.lit(1), at), cut(at + 2, F.lit(1)), cut(at + 1, F.lit(1)), cut(at + 3, F.length(c))))


def spoilt_cell(c: Column, roll: Column) -> Column:
    """One of three: nothing is left, two neighbours change places, or the first half is left of three characters or more."""
    half = F.when(F.length(c) < 3, c).otherwise(F.substring(c, F.lit(1), F.floor(F.length(c) / 2).cast("int")))
    return F.when(c.isNull(), c).when(roll % 3 == 0, F.lit("")).when(roll % 3 == 1, swapped(c, F.floor(roll / 3))).otherwise(half)


def spoilt_key(c: Column, roll: Column) -> Column:
    """One of three small ones, so that a key never gets lost: neighbours change places, a blank at the end, or the last of two characters or more goes."""
    shorter = F.when(F.length(c) < 2, c).otherwise(F.substring(c, F.lit(1), F.length(c) - 1))
    return F.when(roll % 3 == 0, swapped(c, F.floor(roll / 3))).when(roll % 3 == 1, F.concat(c, F.lit(" "))).otherwise(shorter)


def spoilt(c: Column, is_key: Column, roll: Column, tier: int) -> Column:
    """A cell's value after the noise of a tier: from 2 on cells that are no keys are spoilt, from 3 on keys too."""
    if tier < 2:
        return c
    by, key = F.floor(roll / 100), is_key & F.lit(tier >= 3)
    return F.when(key & (roll % 100 < SPOILT_KEYS), spoilt_key(c, by)).when(~is_key & (roll % 100 < SPOILT), spoilt_cell(c, by)).otherwise(c)


def noisy_cells(cells: DataFrame, tier: int, is_key: Column, seed: str) -> DataFrame:
    """Cells (table_id, row_idx, col, value) with noise: tier 1 renames columns, tier 2 spoils cells as well, tier 3 also keys."""
    name, cell = keyed(f"{seed}:name", "table_id", "col"), keyed(seed, "table_id", "row_idx", "col")
    new = F.when(name % 100 < RENAMED, renamed(F.col("col"), F.floor(name / 100))).otherwise(F.col("col")) if tier >= 1 else F.col("col")
    return cells.withColumns({"value": spoilt(F.col("value"), is_key, cell, tier), "col": new})


def swap_corruption(df: DataFrame, key: str, column: str, percent: int, seed: str) -> DataFrame:
    """Masked cells take the value of another row drawn by hash; ``changed`` tells cells whose value is another now. Keys are known and differ."""
    n = df.count()
    rows = ranks.numbered(df, key, "_i")
    own = rows.withColumn("_from", F.when(keyed(f"{seed}:mask", key) % 100 < percent, keyed(f"{seed}:from", key) % max(n, 1)).otherwise(F.col("_i")))
    other = rows.select(F.col("_i").alias("_from"), F.col(column).alias("_new"))
    return own.join(other, "_from").withColumn("changed", ~F.col(column).eqNullSafe(F.col("_new"))).withColumn(column, F.col("_new")).drop("_i", "_from", "_new")


def exact_corruption(df: DataFrame, key: str, columns: list[str], share: float, seed: str) -> DataFrame:
    """In each row exactly int(columns * share) of the columns take the value that another row, drawn by hash for each cell, has there.

    ``changed`` lists the drawn columns. Keys are known and differ.
    """
    n, take = max(df.count(), 1), int(len(columns) * share)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = ranks.numbered(df.select(key, *columns), key, "_i")
    cells = rows.select(key, "_i", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(key, "_i", "x.*")
    order = Window.partitionBy(key).orderBy(keyed(f"{seed}:mask", key, "col"), "col")  # one row's cells
    drawn = cells.withColumn("_hit", F.row_number().over(order) <= take)
    drawn = drawn.withColumn("_from", F.when(F.col("_hit"), keyed(f"{seed}:from", key, "col") % n).otherwise(F.col("_i")))
    other = cells.select(F.col("_i").alias("_from"), "col", F.col("value").alias("_new"))
    new = drawn.join(other, ["_from", "col"])
    hit = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("_hit"), F.col("col"))))).alias("changed")
    return new.groupBy(key).agg(*[F.max(F.when(F.col("col") == c, F.col("_new"))).cast(kinds[c]).alias(c) for c in columns], hit)

"""Expressions over vectors (array<float> or array<double>), reduced in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    """Cosine; a norm under ``least`` counts as 1; NaN and infinity become 0."""
    n = lambda v: F.when(norm(v) < least, F.lit(1.0)).otherwise(norm(v))
    c = dot(a, b) / (n(a) * n(b))
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def l2_normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n == 0, x).otherwise(x / n))


def combine(a: Column, b: Column, how: str, weight: float = 0.5) -> Column:
    """concat, add, weighted (weight * a + (1 - weight) * b), multiply or abs_diff."""
    a, b = doubles(a), doubles(b)
    if how == "concat":
        return F.concat(a, b)
    zipped = {
        "add": lambda x, y: x + y,
        "weighted": lambda x, y: x * weight + y * (1 - weight),
        "multiply": lambda x, y: x * y,
        "abs_diff": lambda x, y: F.abs(x - y),
    }
    return F.zip_with(a, b, zipped[how])


def rounded(v: Column, digits: int = 6) -> Column:
    """Each element rounded; no negative zero."""
    return F.transform(v, lambda x: F.round(x, digits) + F.lit(0.0))


def aggregate_vectors(df: DataFrame, key: str, vector: str, how: str = "mean") -> DataFrame:
    """Element-wise mean, sum, max or min of each key's vectors; partial sums are made before the shuffle."""
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[how]
    cells = df.select(key, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    by_place = cells.groupBy(key, "pos").agg(agg("x").alias("x"))
    return by_place.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vector))

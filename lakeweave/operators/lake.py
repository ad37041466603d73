"""Operators over a lake of tables in the long model: cells (table_id, row_idx, col, value)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.cleaning import normalize_value

from .vector_join import top_k


def cells(df: DataFrame, table_id: str, key: str, columns: list[str]) -> DataFrame:
    """Unpivot: one row per cell."""
    return df.select(F.col(key).cast("long").alias("row_idx"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot("row_idx", columns, "col", "value").withColumn("table_id", F.lit(table_id))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def value_sets(cells: DataFrame) -> DataFrame:
    """Distinct normalised values of each column."""
    return cells.select("table_id", "col", normalize_value(F.col("value")).alias("value")).filter(F.col("value").isNotNull()).distinct()


def capped_postings(values: DataFrame, cap: int | None) -> DataFrame:
    """Values whose posting list is longer than ``cap`` are stop values and go; None keeps all."""
    if cap is None:
        return values
    few = values.groupBy("value").agg(F.count("*").alias("_n")).filter(F.col("_n") <= cap).select("value")
    return values.join(few, "value", "left_semi")


def containment_join(queries: DataFrame, lake: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Top k columns of other tables by the share of the query's values that they contain; ties by table, then column."""
    q = queries.select(F.col("table_id").alias("q_table"), F.col("col").alias("q_col"), "value")
    size = q.groupBy("q_table", "q_col").agg(F.count("*").alias("q_size"))
    hits = q.join(lake, "value").filter("q_table <> table_id").groupBy("q_table", "q_col", "table_id", "col").agg(F.count("*").alias("hits"))
    scored = hits.join(size, ["q_table", "q_col"]).withColumn("containment", F.round(F.col("hits") / F.col("q_size"), digits))
    return top_k(scored, ["q_table", "q_col"], k, F.col("containment").desc(), F.col("table_id"), F.col("col"))


def shared_values(sets: DataFrame, most: int = 2048) -> DataFrame:
    """(q, c, x): pairs of different tables and how many distinct values they share, both ways round. ``sets`` is (t, v), rows may repeat.

    Up to ``most`` tables, a task multiplies matrices of values by tables and gives its sums once, so that no row is made for a value and a pair
    of tables. More tables meet by a join on values.
    """
    sets = sets.select("t", "v").filter("t is not null and v is not null")
    names = [r.t for r in sets.select("t").distinct().limit(most + 1).collect()]
    if len(names) > most:
        s = sets.distinct()
        return s.withColumnRenamed("t", "q").join(s.withColumnRenamed("t", "c"), "v").filter("q <> c").groupBy("q", "c").agg(F.count("*").alias("x"))
    kind = sets.schema["t"].dataType.simpleString()
    held = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    rows = max((1 << 24) // max(len(names), 1), 1)  # a matrix has 64 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, n = pa.array(names, held), [], 0
        total = np.zeros((len(names), len(names)), np.int64)

        def add(t: np.ndarray, v: np.ndarray) -> None:
            m = np.zeros((int(v[-1]) + 1, len(names)), np.float32)
            m[v, t] = 1.0
            total[:] += (m.T @ m).astype(np.int64)

        for b in batches:
            t = pc.index_in(b.column(0), value_set=known).to_numpy()
            waiting, n = [*waiting, (t, b.column(1))], n + b.num_rows
            if n >= rows:
                t, v = np.concatenate([x for x, _ in waiting]), pa.chunked_array([x for _, x in waiting]).combine_chunks()
                code = pc.dictionary_encode(v).indices.to_numpy()  # rows come in order of values
                whole = int(np.argmax(code == code[-1]))
                if whole:
                    add(t[:whole], code[:whole])
                waiting, n = [(t[whole:], v.slice(whole))], n - whole
        if n:
            code = pc.dictionary_encode(pa.chunked_array([x for _, x in waiting]).combine_chunks()).indices.to_numpy()
            add(np.concatenate([x for x, _ in waiting]), code)
        np.fill_diagonal(total, 0)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([known.take(pa.array(i)), known.take(pa.array(j)), pa.array(total[i, j])], names=["q", "c", "x"])

    met = sets.repartition("v").dropDuplicates(["t", "v"]).sortWithinPartitions("v").mapInArrow(run, f"q {kind}, c {kind}, x long")
    return met.groupBy("q", "c").agg(F.sum("x").alias("x"))


def column_profile(cells: DataFrame) -> DataFrame:
    """Counts, nulls, distinct normalised values, uniqueness, non-null share, widths, and whether a column is text."""
    v = F.lower(F.col("value"))
    known = F.col("value").isNotNull()
    a = cells.groupBy("table_id", "col").agg(
        F.count("*").alias("n"), F.count(F.when(known, 1)).alias("n_known"), F.countDistinct(v).alias("n_distinct"),
        F.count(F.when(known & F.col("value").try_cast("double").isNull(), 1)).alias("n_text"), F.max(F.length("value")).cast("long").alias("width"),
    )
    share = lambda x, y: F.round(F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0)), 6)
    return a.select("table_id", "col", "n", "n_known", "n_distinct", share("n_distinct", "n_known").alias("uniqueness"), share("n_known", "n").alias("known"), (F.col("n_text") > 0).alias("is_text"), "width")


def key_column(profile: DataFrame, order: Column, uniqueness: float = 0.8, known: float = 0.9) -> DataFrame:
    """A table's key: unique and filled enough, text before numbers, then the most unique, then the first column."""
    ok = profile.filter((F.col("uniqueness") >= uniqueness) & (F.col("known") >= known))
    return top_k(ok, ["table_id"], 1, F.col("is_text").desc(), F.col("uniqueness").desc(), order).drop("rank")


def minhash(sets: DataFrame, by: list[str], words: str, seeds: int) -> DataFrame:
    """``seeds`` minima of hashes of each group's values; rows hold them as arrays ``words``, and rows without any leave none.

    Four hashes are cut from one md5. They are compared as hex digits, whose order is that of the numbers, within a row, and become numbers once
    a row. What is summed up and shuffled are a row's numbers, never its values: minima of texts would sort all values of a task.
    """
    digest = lambda i: F.transform(words, lambda w: F.md5(F.concat(F.lit(f"{i}:"), w).cast("binary")))
    first = lambda i: F.array_min(F.transform(f"_d{i // 4}", lambda d: F.substring(d, 8 * (i % 4) + 1, 8)))
    digests, least = [digest(i).alias(f"_d{i}") for i in range((seeds + 3) // 4)], [first(i).alias(f"h{i}") for i in range(seeds)]
    rows = sets.filter(F.size(words) > 0).select(*by, *digests).select(*by, *least)
    numbers = rows.select(*by, *[F.conv(f"h{i}", 16, 10).cast("long").alias(f"h{i}") for i in range(seeds)])
    return numbers.groupBy(*by).agg(*[F.min(f"h{i}").alias(f"h{i}") for i in range(seeds)])


def multiset_f1(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """tp, precision, recall and F1 of bag a against bag b."""
    x = a.groupBy(value).agg(F.count("*").alias("x"))
    y = b.groupBy(value).agg(F.count("*").alias("y"))
    s = x.join(y, value, "full").agg(F.sum(F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))).alias("tp"), F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    p, r = F.col("tp") / F.col("nx"), F.col("tp") / F.col("ny")
    return s.select("tp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * F.col("tp") / (F.col("nx") + F.col("ny")), 6).alias("f1"))


def one_to_one(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Equi-join in which the n-th row of a key on the left meets the n-th on the right."""
    from pyspark.sql import Window

    number = lambda df, o: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(o)))
    return number(left.filter(F.col(key).isNotNull()), left_order).join(number(right.filter(F.col(key).isNotNull()), right_order), [key, "_n"]).drop("_n")


def enrich(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left outer join that keeps the left row; a right column whose name the left has gets the suffix _join."""
    own = right.select(F.col(right_key).alias("_k"), *[F.col(c).alias(f"{c}_join" if c in left.columns else c) for c in right.columns if c != right_key])
    return left.join(own, F.col(left_key) == F.col("_k"), "left").drop("_k")


def append_aligned(left: DataFrame, right: DataFrame, alignment: dict[str, str]) -> DataFrame:
    """Rows of ``right`` under the names of ``left`` (left name to right name); what is not aligned is null."""
    own = right.select(*[F.col(r).cast(left.schema[c].dataType).alias(c) for c, r in alignment.items()])
    return left.unionByName(own, allowMissingColumns=True)


def column_sketch(df: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """One row a column: nulls (empty texts are nulls), distinct values (all nulls count as one), and of numbers the nine deciles, mean,
    population deviation (0 for up to two values), least and largest; of texts the mean width of a row in bytes.

    A column of numbers that is null throughout, or has one value, has no figures. Counts of distinct values, dealt out by ranges, give
    them all: no task has all values of a column.
    """
    from lakeweave.operators import ranks

    deciles = {f"q{i}": i / 10 for i in range(1, 10)}
    x = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "col", "x")
    about = x.groupBy("col").agg(F.count_if(F.col("x").isNull()).alias("n_null"))
    r = ranks.counted(x, "x", ["col"])
    mean = r.groupBy("col").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("_m"), F.count("*").alias("_k"))
    figures = r.join(mean, "col").groupBy("col", "_k").agg(
        F.max("_m").alias("mean"), F.sqrt(F.sum(F.col("n") * (F.col("x") - F.col("_m")) ** 2) / F.sum("n")).alias("deviation"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    out = about.join(figures, "col", "left").join(ranks.quantiles(r, "x", deciles, ["col"]), "col", "left")
    unique = F.coalesce("_k", F.lit(0)) + (F.col("n_null") > 0).cast("long")
    out = out.withColumn("n_unique", unique).withColumn("deviation", F.when(F.col("n_unique") > 2, F.col("deviation")).when(F.col("_k").isNotNull(), F.lit(0.0)))
    shown = [*deciles, "mean", "deviation", "low", "high"]
    numbered = out.select("col", F.lit("number").alias("kind"), "n_null", "n_unique", *[F.when(F.col("n_unique") > 1, F.round(c, 4)).alias(c) for c in shown], F.lit(None).cast("double").alias("width"))
    v = df.select(*[F.col(c).cast("string").alias(c) for c in texts]).unpivot([], texts, "col", "x").withColumn("x", F.when(F.col("x") != "", F.col("x")))
    each = v.groupBy("col", "x").agg(F.count("*").alias("n"))
    words = each.groupBy("col").agg(F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("*").alias("n_unique"), (F.sum(F.col("n") * F.coalesce(F.octet_length("x"), F.lit(0))) / F.sum("n")).alias("width"))
    return numbered.unionByName(words.select("col", F.lit("text").alias("kind"), "n_null", "n_unique", *[F.lit(None).cast("double").alias(c) for c in shown], F.round("width", 4).alias("width")))


def sample_values(cells: DataFrame) -> DataFrame:
    """(table_id, col, value): the first cell of each column that is not empty."""
    return cells.filter("trim(value) <> ''").groupBy("table_id", "col").agg(F.min_by("value", "row_idx").alias("value"))

"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power a, normalised. The exponent is bisected over [0, 1]: lower
exponents are nearer to uniform. It is the largest one that reaches the target entropy (ENTROPY of the entropy of equal
weights), unless a source would then be repeated over MAX_REPEAT times as often as the least repeated one; then the
smallest exponent within that limit is taken. Each step of the bisection is one aggregate over the table of sources.

Weights become budgets of tokens. Without a given budget the least one is taken that has every document once. Each
source is read in epochs, each in its own random order, until its budget is spent; what has been read of it so far, as a
share of its budget, gives the block of a row. So every block of BLOCK_TOKENS tokens has the sources in their weights, and
within a block the rows of all sources are permuted.

No source is put in order in one piece: its rows are cut by the random number that orders them into cells of CELL rows
or so, sums run within cells, and a cell starts at the sum of the cells before it. These sums run in two levels: within
groups of CELL cells, and over the groups of a source.

Tokens are words here (runs of anything but ASCII white space). Defined cases: a null source is a source of its own;
a document without tokens weighs one token, so that it has a place; rows that are equal in all columns are placed
each; rows that share their key but not their tokens are ordered by their tokens; texts of any length are counted whole; an
empty table gives an empty result; other columns are passed on by ``mix`` and left out by ``plan``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from ._common import WORD, documents, stash, unused

ENTROPY, MAX_REPEAT, BLOCK_TOKENS, CELL, STEPS = 0.97, 2.0, 1_000_000, 2_000, 40


def exponent(shares: DataFrame, entropy: float = ENTROPY, max_repeat: float = MAX_REPEAT) -> float:
    """``shares`` has one row per source and its share in column ``share``."""
    count, low, high = shares.agg(F.count("*"), F.min("share"), F.max("share")).first()
    if not count or count < 2:
        return 1.0

    def entropy_at(a: float) -> float:
        p = F.pow("share", F.lit(a))
        z, s = shares.agg(F.sum(p), F.sum(p * F.log(p))).first()
        return math.log(z) - s / z

    def largest(ok) -> float:
        if ok(1.0):
            return 1.0
        a, b = 0.0, 1.0
        for _ in range(STEPS // 2):
            m = (a + b) / 2
            a, b = (m, b) if ok(m) else (a, m)
        return a

    best = largest(lambda a: entropy_at(a) >= entropy * math.log(count))
    within = 1.0 - largest(lambda x: x * (math.log(high) - math.log(low)) <= math.log(max_repeat))
    return max(best, within)


def plan(docs: DataFrame, key: list[str], source_col: str, token_col: str, budget: float | None = None, entropy: float = ENTROPY, max_repeat: float = MAX_REPEAT, seed: int = 0) -> DataFrame:
    """Where each copy of each row goes: key, source, tokens, epoch, block, place (its random number within the block), weight."""
    own = docs.select(*key, F.col(source_col).alias("_source"), F.greatest(F.col(token_col), F.lit(1)).cast("long").alias("_n"))
    sources = stash(own.groupBy("_source").agg(F.sum("_n").alias("_t"), F.count("*").alias("_rows")))
    total = sources.agg(F.sum("_t")).first()[0] or 0
    shares = sources.withColumn("share", F.col("_t") / F.lit(float(total or 1)))
    a = exponent(shares, entropy, max_repeat)
    z, cover = shares.agg(F.sum(F.pow("share", F.lit(a))), F.max(F.pow("share", F.lit(1 - a)))).first()
    if budget is None:
        budget = (z or 0.0) * (cover or 0.0) * total
    weight = F.pow("share", F.lit(a)) / F.lit(z or 1.0)
    shares = shares.select(
        F.col("_source").alias("_of"), weight.alias("weight"), (weight * F.lit(float(budget))).alias("_budget"), F.col("_t").cast("double").alias("_t"),
        F.ceil(F.col("_rows") / CELL).alias("_cells"),
    )
    blocks = max(1, round(budget / BLOCK_TOKENS))
    rows = own.join(shares, F.col("_source").eqNullSafe(F.col("_of"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil(F.col("_budget") / F.col("_t") - 1e-9) - 1)).cast("int"))))
    rows = rows.withColumn("_u", F.xxhash64(F.lit(seed), F.col("epoch"), *key)).withColumn("_cell", F.floor((F.shiftrightunsigned("_u", 11) / F.lit(float(1 << 53))) * F.col("_cells")))
    cell = ["_source", "epoch", "_cell"]
    sums = rows.groupBy(*cell).agg(F.sum("_n").alias("_s")).withColumn("_group", F.floor(F.col("_cell") / CELL))
    upto = lambda c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = sums.groupBy("_source", "epoch", "_group").agg(F.sum("_s").alias("_g")).withColumn("_upto", upto("_g", ["_source", "epoch"], "_group"))
    top = top.select(F.col("_source").alias("_a"), F.col("epoch").alias("_b"), F.col("_group").alias("_c"), "_upto")
    same = F.col("_source").eqNullSafe(F.col("_a")) & (F.col("epoch") == F.col("_b")) & (F.col("_group") == F.col("_c"))
    before = sums.withColumn("_before", upto("_s", ["_source", "epoch", "_group"], "_cell")).join(top, same).withColumn("_before", F.col("_before") + F.col("_upto"))
    before = before.select(*[F.col(c).alias(f"{c}_") for c in cell], "_before")
    within = F.coalesce(F.sum("_n").over(Window.partitionBy(*cell).orderBy("_u", *key, "_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_within", within)
    rows = rows.join(before, F.col("_source").eqNullSafe(F.col("_source_")) & (F.col("epoch") == F.col("epoch_")) & (F.col("_cell") == F.col("_cell_")))
    rows = rows.withColumn("_at", F.col("epoch") * F.col("_t") + F.col("_before") + F.col("_within")).filter(F.col("_at") < F.col("_budget") - 1e-6)
    return rows.select(*key, F.col("_source").alias("source"), F.col("_n").alias("n_tokens"), "epoch", F.floor(F.col("_at") / F.col("_budget") * blocks).cast("long").alias("block"), F.xxhash64(F.lit(seed + 1), F.col("epoch"), *key).alias("place"), "weight")


def tokens(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def hashable(field: StructField) -> Column:
    """The column, or its JSON where Spark has no hash for its kind."""
    own = F.col(f"`{field.name}`")
    kind = field.dataType.simpleString()
    return F.to_json(F.struct(own)) if "map<" in kind or "variant" in kind else own


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents, each as often as its source's budget asks for, block by block: all columns of ``docs``.

    Rows that share an id are told apart by a digest of all columns, and equal rows by their number.
    """
    mark, own, block, place = unused(docs, "_digest", "_own", "_block", "_place")
    marked = docs.withColumn(mark, F.xxhash64(*[hashable(f) for f in docs.schema]))
    narrow = marked.select(F.col(id_col).alias("_id"), F.col(mark).alias("_mark"), F.col(source_col).alias("_from"), tokens(text_col).alias("_tokens"))
    narrow = narrow.groupBy("_id", "_mark", "_from", "_tokens").agg(F.count("*").alias("_copies"))
    narrow = stash(narrow.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))))
    places = plan(narrow, ["_id", "_mark", "_copy"], "_from", "_tokens", **options)
    places = places.select(F.col("_id").alias(own), F.col("_mark").alias(f"{mark}_"), F.col("block").alias(block), F.col("place").alias(place))
    one = marked.dropDuplicates([id_col, mark]) if narrow.filter("_copy > 1").limit(1).count() else marked
    out = one.join(places, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(mark) == F.col(f"{mark}_")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.select(*docs.columns, block, place).repartition(n, block).sortWithinPartitions(block, place).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stash(documents(spark, sf_dir).select("doc_id", "source", tokens("text").alias("n_tokens")))
    return plan(docs, ["doc_id"], "source", "n_tokens")

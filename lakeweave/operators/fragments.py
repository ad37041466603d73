"""Parents cut into a seed, a part to append and a part to join, with noise of four tiers and the truth about every row and column.

Tables are in the cell model (table_id, row_idx, col_idx, col, value); a table's rows have different numbers, and so have its columns. A parent's rows are
parted by a cut in the order of their hashes: the cut is one row a table, so cells are never shuffled to be dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.operators import ranks
from lakeweave.operators.prepare import RENAMED, keyed, renamed, spoilt
from lakeweave.sources.writers import checkpoint_dir

#: Shares of columns and rows in the seed, the least of either, and what the other parts keep at least.
COLUMN_SHARE, ROW_SHARE = (0.35, 0.50), (0.60, 0.80)
LEAST_COLUMNS, LEAST_ROWS, OTHER_COLUMNS, OTHER_ROWS = 2, 10, 2, 5
#: Least and most rows and columns from nowhere.
SPURIOUS_ROWS, SPURIOUS_COLUMNS = (2, 5), (1, 2)
NOWHERE = -1


def _share(bounds: tuple[float, float], roll: Column, whole: Column, least: int, other: int) -> Column:
    """A share of ``whole`` between the bounds, rounded half to even; ``least`` at least, and ``other`` are left."""
    u = (roll + 0.5) / F.lit(2147483648.0)
    return F.least(F.greatest(F.lit(least), F.bround((F.lit(bounds[0]) + F.lit(bounds[1] - bounds[0]) * u) * whole).cast("int")), whole - other)


def base_split(cells: DataFrame, keys: DataFrame, seed: str = "0") -> DataFrame:
    """The cells of each parent with a column ``kind``: seed, union (other rows, the seed's columns) or join (all rows, the key and the other columns).

    ``keys`` is (table_id, key_idx). Parents with under four columns beside the key, or under six rows, are left out.
    """
    keys = ranks.beside(keys)
    cols = cells.groupBy("table_id", "col_idx").agg(F.count("*").alias("n_rows")).join(keys, "table_id")
    others = cols.filter("col_idx <> key_idx")
    n_others = others.groupBy("table_id").agg(F.count("*").cast("int").alias("_n")).filter(F.col("_n") >= LEAST_COLUMNS + OTHER_COLUMNS)
    by_hash = Window.partitionBy("table_id").orderBy(keyed(f"{seed}:col", "table_id", "col_idx"), "col_idx")
    chosen = others.join(n_others, "table_id").withColumn("_r", F.row_number().over(by_hash))
    chosen = chosen.filter(F.col("_r") <= _share(COLUMN_SHARE, keyed(f"{seed}:cols", "table_id"), F.col("_n"), LEAST_COLUMNS, OTHER_COLUMNS))
    chosen = chosen.groupBy("table_id", "key_idx").agg(F.collect_list("col_idx").alias("_own"))
    rows = cells.join(keys, "table_id").filter("col_idx = key_idx").select("table_id", "row_idx")
    n_rows = rows.groupBy("table_id").agg(F.count("*").cast("int").alias("_n")).filter(F.col("_n") > OTHER_ROWS)
    roll = keyed(f"{seed}:row", "table_id", "row_idx")
    placed = ranks.placed(rows.withColumn("_h", roll), "_h", ["row_idx"], "_place", ["table_id"]).join(ranks.beside(n_rows), "table_id")
    cut = placed.filter(F.col("_place") == _share(ROW_SHARE, keyed(f"{seed}:rows", "table_id"), F.col("_n"), LEAST_ROWS, OTHER_ROWS))
    cut = cut.select("table_id", F.col("_h").alias("_cut"), F.col("row_idx").alias("_cut_row"))
    x = cells.join(ranks.beside(chosen.join(cut, "table_id")), "table_id").withColumn("_h", roll)
    in_seed = (F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut")) & (F.col("row_idx") < F.col("_cut_row")))
    key, own = F.col("col_idx") == F.col("key_idx"), F.array_contains("_own", F.col("col_idx"))
    kinds = F.array(F.when(key | own, F.when(in_seed, "seed").otherwise("union")), F.when(key | ~own, "join"))
    return x.select(*cells.columns, key.alias("is_key"), F.explode(F.array_compact(kinds)).alias("kind"))


def fragments(cells: DataFrame, keys: DataFrame, tier: int, seed: str = "0") -> DataFrame:
    """The cells of all fragments of one tier: fragment_id, table_id, kind, row_idx, col_idx, col, value, row_parent, col_parent, is_key.

    Seeds are clean. Of the other kinds, tier 1 renames and shuffles columns, tier 2 shuffles rows and spoils cells but keys
    too, tier 3 spoils keys and adds rows and columns that have no parent (row_parent or col_parent -1) as well.
    """
    x = base_split(cells, keys, seed).withColumn("fragment_id", F.concat_ws("__", "table_id", "kind", F.lit(f"t{tier}"), F.lit(f"r{seed}")))
    x = x.withColumnsRenamed({"row_idx": "row_parent", "col_idx": "col_parent"})
    noisy = F.col("kind") != "seed"
    roll = lambda what, *by: keyed(f"{seed}:{tier}:{what}", "fragment_id", *by)
    cols = x.groupBy("fragment_id", "col_parent").agg(F.first("kind").alias("kind"))
    order = F.when(noisy, roll("columns", "col_parent")).otherwise(0) if tier >= 1 else F.lit(0)
    cols = cols.withColumn("col_idx", F.row_number().over(Window.partitionBy("fragment_id").orderBy(order, "col_parent")) - 1)
    rows = x.filter("is_key").select("fragment_id", "kind", "row_parent")
    at = F.when(noisy, roll("row", "row_parent")).otherwise(F.col("row_parent")) if tier >= 2 else F.col("row_parent")
    rows = ranks.placed(rows.withColumn("_h", at.cast("long")), "_h", ["row_parent"], "row_idx", ["fragment_id"])
    x = x.join(ranks.beside(cols.drop("kind")), ["fragment_id", "col_parent"]).join(rows.select("fragment_id", "row_parent", "row_idx").hint("merge"), ["fragment_id", "row_parent"])
    if tier >= 1:
        name = roll("name", "col_parent")
        x = x.withColumn("col", F.when(noisy & (name % 100 < RENAMED), renamed(F.col("col"), F.floor(name / 100))).otherwise(F.col("col")))
    if tier >= 2:
        cell = roll("cell", "row_parent", "col_parent")
        x = x.withColumn("value", F.when(noisy, spoilt(F.col("value"), F.col("is_key"), cell, tier)).otherwise(F.col("value")))
    names = ["fragment_id", "table_id", "kind", "row_idx", "col_idx", "col", "value", "row_parent", "col_parent", "is_key"]
    x = x.select(*names)
    if tier < 3:
        return x
    checkpoint_dir(cells.sparkSession)
    x = x.checkpoint()  # read four times below
    between = lambda bounds, r: F.lit(bounds[0]) + (r % (bounds[1] - bounds[0] + 1)).cast("int")
    sizes = rows.filter(noisy).groupBy("fragment_id").agg(F.count("*").alias("_n")).join(cols.groupBy("fragment_id").agg(F.count("*").cast("int").alias("_m")), "fragment_id")
    new_rows = sizes.withColumn("_j", F.explode(F.sequence(F.lit(1), between(SPURIOUS_ROWS, roll("new rows"))))).withColumn("col_idx", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    new_rows = new_rows.select("fragment_id", "col_idx", (roll("from", "_j", "col_idx") % F.col("_n")).alias("row_idx"), (F.col("_n") + F.col("_j") - 1).alias("_to"))
    x = x.unionByName(x.join(ranks.beside(new_rows), ["fragment_id", "row_idx", "col_idx"]).withColumn("row_idx", F.col("_to")).withColumn("row_parent", F.lit(NOWHERE)).select(*names))
    # a column from nowhere is another one's values, with the rows in the order of a hash
    extra = F.transform(
        F.sequence(F.lit(1), between(SPURIOUS_COLUMNS, roll("new columns"))),
        lambda j: F.struct(j.alias("j"), (roll("like", j) % F.col("_m")).cast("int").alias("like"), F.concat(F.lit("extra_"), 1000 + roll("called", j) % 9000).alias("name")),
    )
    new_cols = sizes.select("fragment_id", "_m", F.explode(extra).alias("_e")).select("fragment_id", "_m", F.col("_e.j").alias("_j"), F.col("_e.like").alias("col_idx"), F.col("_e.name").alias("_name"))
    new_cols = x.join(ranks.beside(new_cols), ["fragment_id", "col_idx"]).withColumn("_h", roll("by", "_j", "row_idx"))
    new_cols = ranks.placed(new_cols, "_h", ["row_idx"], "_to", ["fragment_id", "_j"])
    new_cols = new_cols.withColumns({"row_idx": F.col("_to"), "col_idx": F.col("_m") + F.col("_j") - 1, "col": F.col("_name"), "col_parent": F.lit(NOWHERE), "is_key": F.lit(False)})
    parents = x.groupBy("fragment_id", "row_idx").agg(F.max("row_parent").alias("row_parent"))
    return x.unionByName(new_cols.drop("row_parent").join(parents.hint("merge"), ["fragment_id", "row_idx"]).select(*names))


def manifest(cells: DataFrame) -> DataFrame:
    """One row a fragment: id, parent, role, kind, rows, columns, and the key's name here."""
    return cells.groupBy("fragment_id", "table_id", "kind").agg(
        (F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).cast("long").alias("n_cols"), F.max(F.when(F.col("is_key"), F.col("col"))).alias("key_col")
    ).withColumn("role", F.when(F.col("kind") == "seed", "query").otherwise("lake"))

"""Tables with trees of headers, written as one JSON record each.

A record has a matrix of texts (``Texts``) or of formatted cells (``Cells``, the text in ``V``), merged regions, and two trees of header cells:
``TopTreeRoot`` over the columns and ``LeftTreeRoot`` beside the rows, each node with its row ``RI``, column ``CI`` and children ``Cd``. Records
are parsed to variants, as trees have any depth, and trees are opened level by level. All of a record lies in its one row, so that cells get their
places there and nothing is shuffled. A cell's place in a
tree is the path of child numbers of the header cell that it is, or stands below (or beside), written from the tree's own depth on into
``depth`` numbers, -1 where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most levels of a tree, and the most children of a node on each.
DEPTH, DEGREES = 4, (32, 32, 64, 256)
WHITE, BLACK = "ffffff", "000000"


def _get(v: str | Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _numbers(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def parsed(lines: DataFrame, column: str = "value", most_rows: int = 256, most_columns: int = 256) -> DataFrame:
    """(table_id, v, m, n_rows, n_cols): records and their rows, all null but ``table_id``, a column of ``lines``, if they do not parse or are larger than that.

    They are not filtered, as a filter on what is parsed would go below it and parse each record once more.
    """
    x = lines.select("table_id", F.try_parse_json(column).alias("v"))
    x = x.select("table_id", "v", F.coalesce(_get("v", "$.Texts", "array<variant>"), _get("v", "$.Cells", "array<variant>")).alias("m"))
    x = x.select("table_id", "v", "m", F.size("m").alias("n_rows"), F.size(_get(F.get("m", F.lit(0)), "$", "array<variant>")).alias("n_cols"))
    good = F.col("n_rows").between(1, most_rows) & F.col("n_cols").between(1, most_columns)
    return x.select("table_id", *[F.when(good, F.col(c)).alias(c) for c in ("v", "m", "n_rows", "n_cols")])


def regions() -> Column:
    """Merged regions (r0, c0, r1, c1) of a record."""
    names = {"r0": "FirstRow", "c0": "FirstColumn", "r1": "LastRow", "c1": "LastColumn"}
    each = F.transform(_get("v", "$.MergedRegions", "array<variant>"), lambda m: F.struct(*[_get(m, f"$.{n}", "int").alias(c) for c, n in names.items()]))
    return F.coalesce(each, F.array().cast("array<struct<r0:int,c0:int,r1:int,c1:int>>"))


def nodes(root: str, depth: int = DEPTH) -> Column:
    """(path, row, col, children): a record's root of one tree and the nodes below it, one level after the other, and one level more than allowed."""

    def node(path: Column, row: Column, col: Column, below: Column) -> Column:
        return F.struct(path.alias("path"), row.alias("row"), col.alias("col"), below.alias("below"))

    def under(n: Column) -> Column:
        return F.transform(n["below"], lambda x, i: node(F.array_append(n["path"], i), _get(x, "$.RI", "int"), _get(x, "$.CI", "int"), _get(x, "$.Cd", "array<variant>")))

    none = F.lit(None).cast("int")
    start = F.array(node(F.array().cast("array<int>"), none, none, _get("v", f"$.{root}.Cd", "array<variant>")))
    levels = F.reduce(F.sequence(F.lit(0), F.lit(depth)), F.array(start), lambda known, k: F.array_append(known, F.flatten(F.array_compact(F.transform(F.get(known, k), under)))))
    return F.transform(F.flatten(levels), lambda n: F.struct(n["path"].alias("path"), n["row"].alias("row"), n["col"].alias("col"), F.greatest(F.size(n["below"]), F.lit(0)).alias("children")))


def with_spots(tables: DataFrame, name: str, depth: int = DEPTH, degrees: tuple[int, ...] = DEGREES) -> DataFrame:
    """``tables`` with the nodes of the tree ``name`` (top or left) turned to spots: for each column (or row), those that may give its cells their place.

    A node lies in a column ``over`` and a row ``start`` (or the other way round); a leaf counts for the cells behind it from ``a`` to ``b``, too.
    A tree that is too deep places nothing. One with too many children on a level, or none at all, is replaced by the numbers
    of columns (or rows) in the last place, if the last level may have so many.
    """
    top = name == "top"
    over, start, first, last, n_over = ("col", "row", "c0", "c1", "n_cols") if top else ("row", "col", "r0", "r1", "n_rows")
    kept = [c for c in tables.columns if c != name]
    x = tables.withColumn("high", F.array_max(F.transform(name, lambda n: F.size(n["path"]))))
    level = lambda n: F.lit(depth) - F.col("high") + F.size(n["path"])  # noqa: E731  # of the node's children
    wide = F.coalesce(F.exists(name, lambda n: (n["children"] > 0) & (n["children"] > F.get(F.array(*map(F.lit, degrees)), level(n)))), F.lit(False))
    x = x.withColumn("wide", (F.col("high") <= depth) & wide)

    def spot(place: Column, over: Column, start: Column, a: Column, b: Column) -> Column:
        return F.struct(place.alias("place"), over.alias("over"), start.alias("start"), a.alias("a"), b.alias("b"))

    def own(n: Column) -> Column:
        place = F.flatten(F.array(F.array_repeat(F.lit(-1), F.lit(depth) - F.col("high")), n["path"], F.array_repeat(F.lit(-1), F.col("high") - F.size(n["path"]))))
        inside = F.filter("merged", lambda m: n["row"].between(m["r0"], m["r1"]) & n["col"].between(m["c0"], m["c1"]))
        ends = F.array_min(F.transform(inside, lambda m: m[first])), F.array_max(F.transform(inside, lambda m: m[last]))
        return spot(place, n[over], n[start], *[F.when(n["children"] == 0, F.coalesce(e, n[over])) for e in ends])

    instead = (F.col("high") == 0) | F.col("wide")
    owns = F.when(~instead & (F.col("high") <= depth), F.transform(F.filter(name, lambda n: F.size(n["path"]) > 0), own))
    x = x.select(*kept, instead.alias("instead"), owns.alias(name))
    longest = F.array_max(F.transform("m", lambda r: F.size(_get(r, "$", "array<variant>")))) if top else F.col("n_rows")
    lying = F.transform(_numbers(longest), lambda y: F.filter(name, lambda s: (s["over"] == y) | y.between(s["a"], s["b"])))
    flat = F.transform(_numbers(F.col(n_over)), lambda y: F.array(spot(F.flatten(F.array(F.array_repeat(F.lit(-1), depth - 1), F.array(y))), y, F.lit(-1), y, y)))
    # Spots are named twice here: named once, they would be moved into the function and made again for each column.
    return x.select(*kept, F.when(F.col("instead") & (F.col(n_over) <= degrees[-1]), flat).when(F.col(name).isNotNull(), lying).alias(name))


def look(cell: Column) -> Column:
    """Eleven figures of a formatted cell: rows and columns merged (1 here), four borders, date, formula, bold, white ground, black letters."""
    ends = lambda name, with_: F.coalesce((F.substring(_get(cell, f"$.{name}", "string"), 1, 1) == "#") & F.endswith(_get(cell, f"$.{name}", "string"), F.lit(with_)), F.lit(False)).cast("int")
    numbers = [_get(cell, f"$.{n}", "int") for n in ("TB", "BB", "LB", "RB")]
    return F.array(F.lit(1), F.lit(1), *numbers, (_get(cell, "$.DT", "int") > 0).cast("int"), _get(cell, "$.HF", "int"), _get(cell, "$.FB", "int"), ends("BC", WHITE), ends("FC", BLACK))


def read_header_trees(lines: DataFrame, column: str = "value", depth: int = DEPTH, degrees: tuple[int, ...] = DEGREES, most_rows: int = 256, most_columns: int = 256) -> DataFrame:
    """Cells of tables with header trees: (table_id, row, col, title, header_rows, header_cols, text, look, top, left).

    ``lines`` has a unique table_id and the record as text. Records that are no JSON or are too large are left out; ``look`` is null where a
    record has texts alone.
    """
    head = [_get("v", "$.Title", "string").alias("title"), _get("v", "$.TopHeaderRowsNumber", "int").alias("header_rows"), _get("v", "$.LeftHeaderColumnsNumber", "int").alias("header_cols")]
    x = parsed(lines, column, most_rows, most_columns)
    x = x.select("table_id", *head, "m", "n_rows", "n_cols", regions().alias("merged"), nodes("TopTreeRoot", depth).alias("top"), nodes("LeftTreeRoot", depth).alias("left"))
    x = with_spots(with_spots(x, "top", depth, degrees), "left", depth, degrees)
    between = lambda i, a, b: ((a <= i) & (i <= b)) | ((b <= i) & (i <= a))
    x = x.withColumn("merged", F.transform(_numbers(F.col("n_rows")), lambda i: F.filter("merged", lambda m: between(i, m["r0"], m["r1"]))))
    none = F.array_repeat(F.lit(-1), depth)
    heads = [*x.columns[:4], "n_rows", "n_cols"]
    # What is exploded must be no bare column, or Spark makes a filter of it that parses all records once more.
    x = x.select(*heads, "merged", "top", "left", F.posexplode(F.when(F.col("n_rows") > 0, F.col("m"))).alias("row", "r"))
    x = x.select(*heads, "row", "r", F.get("merged", "row").alias("merged"), "top", F.get("left", "row").alias("left"), _get("r", "$", "array<string>").alias("texts"))
    # A path that is not there costs more than all else: only what is written like an object is looked into.
    like = lambda text: F.startswith(text, F.lit("{"))
    x = x.withColumn("cells", F.when(F.exists("texts", like), _get("r", "$", "array<variant>"))).drop("r")

    def place(spots: Column, y: Column, along: Column, n_along: str) -> Column:
        here = F.filter(spots, lambda s: ((s["start"] == along) & (s["over"] == y)) | (s["a"].isNotNull() & (s["start"] < along) & (along < F.col(n_along))))
        return F.coalesce(F.array_max(here)["place"], none)  # the last in the walk

    def cell(text: Column, j: Column) -> Column:
        c, i = F.get("cells", j), F.col("row")
        formatted, own = F.when(like(text), _get(c, "$.V", "string")), look(c)
        size = F.array_max(F.transform(F.filter("merged", lambda m: between(j, m["c0"], m["c1"])), lambda m: F.struct((m["r1"] - m["r0"] + 1).alias("h"), (m["c1"] - m["c0"] + 1).alias("w"))))
        sized = F.when(size.isNotNull(), F.concat(F.array(size["h"], size["w"]), F.slice(own, 3, 9))).otherwise(own)
        return F.struct(j.alias("col"), F.coalesce(formatted, text).alias("text"), F.when(formatted.isNotNull(), sized).alias("look"), place(F.get("top", j), j, i, "n_rows").alias("top"), place(F.col("left"), i, j, "n_cols").alias("left"))

    x = x.select(*heads[:4], "row", F.inline(F.transform("texts", cell)))
    return x.select("table_id", "row", "col", *heads[1:4], "text", "look", "top", "left")

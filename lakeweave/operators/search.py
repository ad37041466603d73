"""Search for table programs whose denotation is a given answer, for many tables and questions at once.

A state is a set of rows that some program reaches. States are kept in long form, a row for each member, and named by a digest of
their members, so programs that reach the same rows meet in one state and are carried on once. Each level is one plan for the
states of all questions: functions run as joins and aggregates over cells, results that are empty or change nothing are pruned, and
states that are already known are dropped by an anti join. Finished expressions are scored by a join with the answers; programs are read
off the graph of states, forwards, through states alone from which an answer can still be reached. Joins are shuffled but for what is one row or a
few a question: Spark's estimates of states and cells come from compressed files and are far too small.

Admissibility follows from denotations: filters, extremes, first and last, and aggregates take two rows or more, ``same`` takes one,
``next`` and ``previous`` are not for the whole table, and a property has to be there for the rows. An answer is met if there are as
many distinct values and each of its values equals one of them, as text or as a number within 1e-6.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.operators import ranks
from lakeweave.operators.program import as_plain, near_value
from lakeweave.sources.writers import checkpoint_dir

KEYS = ["env", "sid"]
HERE = "{v}"  # where an expression names the rows that it works on


@dataclass
class Questions:
    """``cells``: (tab, row, prop, kind, texts, nums), a row for each property of each row of a table, rows numbered from 0, kind
    ``number`` or ``string``, arrays empty where the cell is. ``asked``: (env, tab). ``given``: (env, value), what a question names.
    ``answers``: (env, value)."""

    cells: DataFrame
    asked: DataFrame
    given: DataFrame
    answers: DataFrame


def cells_of(table: DataFrame, tab: str, row: str, props: dict[str, str]) -> DataFrame:
    """Cells of a wide table of single values; ``props`` maps columns to kinds."""
    each = [F.struct(F.lit(p).alias("prop"), F.lit(kind).alias("kind"), F.col(p).cast("string").alias("x")) for p, kind in props.items()]
    long = table.select(F.col(tab).alias("tab"), F.col(row).cast("long").alias("row"), F.explode(F.array(*each)).alias("c")).select("tab", "row", "c.*")
    texts = F.when(F.col("x").isNull(), F.array().cast("array<string>")).otherwise(F.array("x"))
    return long.select("tab", "row", "prop", "kind", texts.alias("texts"), F.transform(texts, lambda x: x.try_cast("double")).alias("nums"))


def expression(name: str, *args: str | Column) -> Column:
    return F.concat_ws(" ", F.lit("("), F.lit(name), F.lit(HERE), *[F.lit(a) if isinstance(a, str) else a for a in args], F.lit(")"))


def filters(base: DataFrame, given: DataFrame) -> DataFrame:
    """Rows of each state that pass a filter on one property by one given value."""
    g, num = F.col("value"), F.col("value").try_cast("double")
    number, first = (F.col("kind") == "number") & num.isNotNull(), F.get("texts", F.lit(0))
    own, one = F.when(F.col("kind") == "number", F.array_distinct("nums").cast("array<string>")).otherwise(F.array_distinct("texts")), F.when(F.col("kind") == "number", num.cast("string")).otherwise(g)
    some = lambda test: number & F.exists("nums", lambda x: test(x, num))
    typed, text = number | (F.col("kind") == "string") & num.isNull(), (F.col("kind") == "string") & num.isNull() & first.isNotNull()
    tests = {
        "filter_ge": some(lambda x, y: x >= y),
        "filter_greater": some(lambda x, y: x > y),
        "filter_le": some(lambda x, y: x <= y),
        "filter_less": some(lambda x, y: x < y),
        "filter_eq": typed & (own == F.array(one)),
        "filter_not_eq": typed & (own != F.array(one)),
        "filter_str_contain_any": text & F.contains(first, g),
        "filter_str_contain_not_any": text & ~F.contains(first, g),
    }
    passed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    found = base.filter("size > 1").join(given, "env").select(*KEYS, "tab", "row", "prop", "value", F.explode(passed).alias("name"))
    return found.select(*KEYS, "tab", "row", F.concat_ws(" ", F.lit("("), "name", F.lit(HERE), "value", "prop", F.lit(")")).alias("op"))


def extremes(base: DataFrame) -> DataFrame:
    """Rows that have the largest or the smallest number of a property; ties all stay."""
    first = base.filter("size > 1 and kind = 'number'").select(*KEYS, "tab", "row", "prop", F.get("nums", F.lit(0)).alias("x")).filter("x is not null")
    ends = first.groupBy(*KEYS, "prop").agg(F.max("x").alias("high"), F.min("x").alias("low"))
    names = F.array_compact(F.array(F.when(F.col("x") == F.col("high"), F.lit("argmax")), F.when(F.col("x") == F.col("low"), F.lit("argmin"))))
    both = first.join(ends.hint("merge"), [*KEYS, "prop"]).select(*KEYS, "tab", "row", "prop", F.explode(names).alias("name"))
    return both.select(*KEYS, "tab", "row", F.concat_ws(" ", F.lit("("), "name", F.lit(HERE), "prop", F.lit(")")).alias("op"))


def ends(states: DataFrame) -> DataFrame:
    one = states.filter("size > 1").groupBy(*KEYS, "tab").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    pairs = F.explode(F.array(*[F.struct(F.col(n).alias("row"), expression(n).alias("op")) for n in ("first", "last")]))
    return one.select(*KEYS, "tab", pairs.alias("x")).select(*KEYS, "tab", "x.row", "x.op")


def neighbours(states: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows below and above, where the table has them."""
    moved = F.explode(F.array(*[F.struct((F.col("row") + by).alias("row"), expression(n).alias("op")) for n, by in (("next", 1), ("previous", -1))]))
    x = states.filter("not whole").select(*KEYS, "tab", moved.alias("x")).select(*KEYS, "tab", "x.row", "x.op")
    return x.join(rows.hint("merge"), ["tab", "row"], "left_semi")


def same(base: DataFrame, cells: DataFrame) -> DataFrame:
    """The other rows with the same set of values as the only row."""
    key = lambda: F.array_sort(F.array_distinct("texts")).alias("set")
    one = base.filter("size = 1 and size(texts) > 0").select(*KEYS, "tab", F.col("row").alias("own"), "prop", key())
    met = one.join(cells.select("tab", "row", "prop", key()).hint("merge"), ["tab", "prop", "set"]).filter("row <> own")
    return met.select(*KEYS, "tab", "row", expression("same", F.col("prop")).alias("op"))


def denotations(states: DataFrame, base: DataFrame) -> DataFrame:
    """(env, sid, op, value): the values of all expressions that end a program."""
    each = base.select(*KEYS, "size", "prop", "kind", F.explode(F.arrays_zip("texts", "nums")).alias("c")).select(*KEYS, "size", "prop", "kind", "c.texts", "c.nums")
    counted = each.groupBy(*KEYS, "size", "prop", "kind", "texts").agg(F.count("*").alias("n"), F.first("nums").alias("x"))
    hops = counted.select(*KEYS, expression("hop", F.col("prop")).alias("op"), F.col("texts").alias("value"))
    many = counted.filter("size > 1")
    most = many.groupBy(*KEYS, "prop").agg(F.max("n").alias("n"))
    modes = many.join(most.hint("merge"), [*KEYS, "prop", "n"]).select(*KEYS, expression("mode", F.col("prop")).alias("op"), F.col("texts").alias("value"))
    whole = many.filter("kind = 'number' and x is not null").groupBy(*KEYS, "prop")
    sums = whole.agg(F.max("x").alias("maximum"), F.min("x").alias("minimum"), F.sum(F.col("x") * F.col("n")).alias("sum"), F.sum("n").alias("_n"))
    sums = sums.withColumn("average", F.col("sum") / F.col("_n"))
    parts = F.explode(F.array(*[F.struct(expression(n, F.col("prop")).alias("op"), F.col(n).cast("string").alias("value")) for n in ("maximum", "minimum", "sum", "average")]))
    counts = states.filter("size > 1").select(*KEYS, expression("count").alias("op"), F.col("size").cast("string").alias("value")).distinct()
    return hops.unionByName(modes).unionByName(sums.select(*KEYS, parts.alias("x")).select(*KEYS, "x.op", "x.value")).unionByName(counts)


def met(found: DataFrame, answers: DataFrame) -> DataFrame:
    """(env, sid, op) of the value sets that are the answer. Sets of another size go before anything is compared."""
    plain = lambda df: df.withColumn("value", as_plain(F.col("value"))).distinct()
    want, have = plain(answers), plain(found)
    sizes = ranks.beside(want.groupBy("env").agg(F.count("*").alias("n")))
    fit = have.groupBy(*KEYS, "op").agg(F.count("*").alias("n")).join(sizes, ["env", "n"])
    pairs = have.join(fit.hint("merge"), [*KEYS, "op"]).join(ranks.beside(want).withColumnRenamed("value", "target"), "env").filter(near_value(F.col("value"), F.col("target")))
    return pairs.groupBy(*KEYS, "op", "n").agg(F.countDistinct("target").alias("hit")).filter("hit = n").select(*KEYS, "op")


def _digest(row: Column) -> list[Column]:
    """A name for a set of rows: their number and two sums of their hashes, in whatever order they come."""
    return [F.count("*").alias("n"), F.bit_xor(F.xxhash64(row)).alias("x"), F.sum(F.xxhash64(row, F.lit(1)).cast("decimal(38,0)")).alias("y")]


def _name() -> Column:
    return F.concat_ws(":", "n", "x", "y")


def search(q: Questions, depth: int = 3) -> DataFrame:
    """(env, program, n_expressions): all programs of at most ``depth`` expressions, each but the last a set of rows, that give the answer."""
    checkpoint_dir(q.cells.sparkSession)
    cells, given, answers = q.cells.checkpoint(), ranks.beside(q.given.distinct()), q.answers.checkpoint()
    rows = cells.select("tab", "row").distinct()
    members = rows.join(ranks.beside(q.asked), "tab").select("env", "tab", "row")
    root = members.groupBy("env", "tab").agg(*_digest(F.col("row"))).select("env", "tab", _name().alias("sid"), F.col("n").alias("size"))
    root = ranks.beside(root)
    states = members.join(root, ["env", "tab"]).select(*KEYS, "tab", "row", "size", F.lit(True).alias("whole")).checkpoint()
    known, edges, done = root.select(*KEYS).checkpoint(), [], []
    for level in range(depth):
        base = states.join(cells.hint("merge"), ["tab", "row"])
        done.append(met(denotations(states, base), answers).checkpoint())
        if level == depth - 1:
            break
        made = filters(base, given).unionByName(extremes(base)).unionByName(ends(states)).unionByName(neighbours(states, rows)).unionByName(same(base, cells)).checkpoint()
        named = made.groupBy(*KEYS, "op", "tab").agg(*_digest(F.col("row"))).withColumn("to", _name()).filter(F.col("to") != F.col("sid")).checkpoint()
        edges.append(named.select(*KEYS, "op", "to"))
        new = named.groupBy("env", "to", F.col("n").alias("size")).agg(F.min(F.struct("sid", "op")).alias("by"))
        new = new.join(known.select("env", F.col("sid").alias("to")).hint("merge"), ["env", "to"], "left_anti").select("env", "to", "size", "by.*")
        states = made.join(new.hint("merge"), [*KEYS, "op"]).select("env", F.col("to").alias("sid"), "tab", "row", "size", F.lit(False).alias("whole")).checkpoint()
        known = known.unionByName(new.select("env", F.col("to").alias("sid"))).checkpoint()
    return programs(root, edges, done, depth)


def programs(root: DataFrame, edges: list[DataFrame], done: list[DataFrame], depth: int) -> DataFrame:
    """Read the programs off the graph; a walk enters a state alone from which an answer lies within its remaining steps."""
    last = done[0]
    for d in done[1:]:
        last = last.unionByName(d)
    last = last.checkpoint()
    steps = None
    for e in edges:
        steps = e if steps is None else steps.unionByName(e)
    useful = [last.select(*KEYS).distinct()]
    for _ in range(depth - 1):
        towards = steps.join(useful[-1].select("env", F.col("sid").alias("to")).hint("merge"), ["env", "to"], "left_semi").select(*KEYS)
        useful.append(useful[0].unionByName(towards).distinct().checkpoint())
    walk, out = root.select(*KEYS, F.array().cast("array<string>").alias("path")), None
    for level in range(depth):
        ended = walk.join(last.hint("merge"), KEYS).select("env", F.concat("path", F.array("op")).alias("path"))
        out = ended if out is None else out.unionByName(ended)
        if level < depth - 1:
            walk = walk.join(steps.hint("merge"), KEYS).select("env", F.col("to").alias("sid"), F.concat("path", F.array("op")).alias("path")).join(useful[depth - 2 - level].hint("merge"), KEYS, "left_semi")
    name = lambda i: F.when(i == 0, F.lit("all_rows")).otherwise(F.concat(F.lit("v"), (i - 1).cast("string")))
    text = F.array_join(F.transform("path", lambda x, i: F.replace(x, F.lit(HERE), name(i))), "\n")
    return out.select("env", text.alias("program"), F.size("path").alias("n_expressions"))

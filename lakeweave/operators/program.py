"""A typed language of table programs: S-expressions over one table, compiled to DataFrame plans.

    ( filter_ge ( hop v0 r.size-number ) 10 )

A program is read token by token; each complete expression is bound to v0, v1, .. and may be used by the next. A table is a
DataFrame with a row number ``row_idx`` and columns whose values are arrays (a cell may have several values).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions import cleaning as C

#: The types and what each of them also is.
TYPES = {
    "num_list": ["ordered_list"], "datetime_list": ["ordered_list"], "ordered_list": ["atom_list"], "string_list": ["atom_list"], "atom_list": ["list"], "entity_list": ["list"], "list": [],
    "num_property": ["ordered_property"], "datetime_property": ["ordered_property"], "ordered_property": ["property"], "string_property": ["property"], "property": [], "num": [], "bool": [],
}


def ancestors(kind: str, tree: dict[str, list[str]] = TYPES) -> set[str]:
    """The type and all that it is, by the closure of the tree."""
    out, todo = set(), [kind]
    while todo:
        if (k := todo.pop()) not in out:
            out.add(k)
            todo += tree[k]
    return out


def tokenize(text: str) -> list[str]:
    return text.replace("(", " ( ").replace(")", " ) ").split()


def parse(tokens: list[str]):
    """One expression as nested lists."""
    stack: list[list] = [[]]
    for token in tokens:
        if token == "(":
            stack.append([])
        elif token == ")":
            if len(stack) == 1:
                raise SyntaxError("a ) without its (")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(token)
    if len(stack) != 1 or len(stack[0]) != 1:
        raise SyntaxError("not one whole expression")
    return stack[0][0]


@dataclass
class Value:
    kind: str
    data: object  # a DataFrame of rows or of (value), or a Column for a property's name


@dataclass
class Function:
    args: list[str]
    returns: str | Callable
    run: Callable


#: Registered functions: the place where users add their own.
FUNCTIONS: dict[str, Function] = {}


def function(name: str, args: list[str], returns):
    def add(run):
        FUNCTIONS[name] = Function(args, returns, run)
        return run

    return add


def _type_of(prop: str) -> str:
    return {"number": "num_property", "date": "datetime_property"}.get(prop.rpartition("-")[2], "string_property")


def _list_of(prop: str) -> str:
    return {"num_property": "num_list", "datetime_property": "datetime_list"}.get(_type_of(prop), "string_list")


def values(rows: DataFrame, prop: str, bag: bool = False) -> DataFrame:
    out = rows.select("row_idx", F.posexplode(F.col(f"`{prop}`")).alias("pos", "value"))
    return out if bag else out.dropDuplicates(["value"])


def first(prop: str) -> Column:
    return F.get(F.col(f"`{prop}`"), F.lit(0))


@function("hop", ["entity_list", "property"], _list_of)
def hop(p, rows, prop):
    return values(rows, prop).select("value")


@function("all", ["entity_list", "property"], _list_of)
def hop_bag(p, rows, prop):
    return values(rows, prop, bag=True).select("value")


def _dated(given: DataFrame, prop: str) -> bool:
    """Whether dates are compared that may lack parts: both sides are texts then."""
    return _type_of(prop) == "datetime_property" and given.schema["value"].dataType.simpleString() == "string"


def compare(name: str, sign: str):
    """A row stays if some value of its cell compares true with all of the given values. Dates with parts xx are compared by what the given one has."""
    test = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}[sign]

    def run(p, rows, given, prop):
        if _dated(given, prop):
            each = [C.partial_date(F.lit(r.value)) for r in given.distinct().collect()]  # a handful, by the language's nature
            return rows.filter(F.exists(F.col(f"`{prop}`"), lambda v: functools.reduce(lambda x, y: x & y, (C.date_compare(C.partial_date(v.cast("string")), d, sign) for d in each), F.lit(True))))
        low, high = (given.agg(f("value")).scalar() for f in (F.min, F.max))  # part of the plan, no job of their own
        held = rows.withColumn("_low", low).withColumn("_high", high)
        passed = F.exists(F.col(f"`{prop}`"), lambda v: test(v, F.col("_low")) & test(v, F.col("_high")))
        return held.filter(F.col("_low").isNull() | passed).drop("_low", "_high")

    FUNCTIONS[name] = Function(["entity_list", "ordered_list", "ordered_property"], "entity_list", run)


compare("filter_ge", ">=")
compare("filter_greater", ">")
compare("filter_le", "<=")
compare("filter_less", "<")


def select(name: str, first_wins: Callable[[Column, Column], Column]):
    """Of two rows, in the table's order, the first if its value compares so with the second's, else the second."""

    def run(p, rows, prop):
        two = rows.select("row_idx", first(prop).alias("v")).orderBy("row_idx").limit(3).collect()
        if len(two) != 2:
            raise ValueError(f"{name} takes two rows")
        pair = rows.agg(F.min(F.struct("row_idx", first(prop).alias("v"))).alias("x"), F.max(F.struct("row_idx", first(prop).alias("v"))).alias("y"))
        won = pair.select(F.when(first_wins(F.col("x.v"), F.col("y.v")), F.col("x.row_idx")).otherwise(F.col("y.row_idx")).alias("row_idx"))
        return rows.join(won, "row_idx", "left_semi")

    FUNCTIONS[name] = Function(["entity_list", "ordered_property"], "entity_list", run)


select("select_ge", lambda a, b: a >= b)
select("select_less", lambda a, b: a < b)


def _equal(rows, given, prop):
    own = F.array_sort(F.array_distinct(F.col(f"`{prop}`")))
    return F.coalesce(own == given, F.lit(False))


def _given(given: DataFrame) -> Column:
    """The given values, a handful by the language's nature, as one sorted array."""
    kind = given.schema["value"].dataType.simpleString()
    return F.array(*[F.lit(r[0]) for r in given.distinct().orderBy("value").collect()]).cast(f"array<{kind}>")


@function("filter_eq", ["entity_list", "atom_list", "property"], "entity_list")
def filter_eq(p, rows, given, prop):
    return rows.filter(_equal(rows, _given(given), prop))


@function("filter_not_eq", ["entity_list", "atom_list", "property"], "entity_list")
def filter_not_eq(p, rows, given, prop):
    return rows.filter(~_equal(rows, _given(given), prop))


@function("filter_str_contain_any", ["entity_list", "string_list", "string_property"], "entity_list")
def contain_any(p, rows, given, prop):
    return rows.filter(F.exists(_given(given), lambda s: F.contains(first(prop), s)))


@function("filter_str_contain_not_any", ["entity_list", "string_list", "string_property"], "entity_list")
def contain_none(p, rows, given, prop):
    return rows.filter(~F.exists(_given(given), lambda s: F.contains(first(prop), s)))


def _extreme(rows, prop, how):
    return rows.filter(first(prop) == rows.agg(how(first(prop))).scalar())


@function("argmax", ["entity_list", "ordered_property"], "entity_list")
def argmax(p, rows, prop):
    return _extreme(rows, prop, F.max)


@function("argmin", ["entity_list", "ordered_property"], "entity_list")
def argmin(p, rows, prop):
    return _extreme(rows, prop, F.min)


@function("first", ["entity_list"], "entity_list")
def first_row(p, rows):
    return rows.filter(F.col("row_idx") == rows.agg(F.min("row_idx")).scalar())


@function("last", ["entity_list"], "entity_list")
def last_row(p, rows):
    return rows.filter(F.col("row_idx") == rows.agg(F.max("row_idx")).scalar())


def _shift(p, rows, by):
    return p.table.join(rows.select((F.col("row_idx") + by).alias("row_idx")), "row_idx")


@function("next", ["entity_list"], "entity_list")
def next_rows(p, rows):
    return _shift(p, rows, 1)


@function("previous", ["entity_list"], "entity_list")
def previous_rows(p, rows):
    return _shift(p, rows, -1)


@function("count", ["entity_list"], "num")
def count(p, rows):
    return rows.agg(F.count("*").cast("double").alias("value"))


@function("maximum", ["entity_list", "ordered_property"], "num")
def maximum(p, rows, prop):
    return values(rows, prop).agg(F.max("value").alias("value"))


@function("minimum", ["entity_list", "ordered_property"], "num")
def minimum(p, rows, prop):
    return values(rows, prop).agg(F.min("value").alias("value"))


@function("sum", ["entity_list", "num_property"], "num")
def total(p, rows, prop):
    return values(rows, prop, bag=True).agg(F.coalesce(F.sum("value"), F.lit(0)).cast("double").alias("value"))


@function("average", ["entity_list", "num_property"], "num")
def average(p, rows, prop):
    return values(rows, prop, bag=True).agg(F.avg("value").alias("value"))


@function("mode", ["entity_list", "property"], _list_of)
def mode(p, rows, prop):
    """All of the most frequent values."""
    n = values(rows, prop, bag=True).groupBy("value").agg(F.count("*").alias("n"))
    return n.filter(F.col("n") == n.agg(F.max("n")).scalar()).select("value")


@function("same", ["entity_list", "property"], "entity_list")
def same(p, rows, prop):
    """The other rows of the table whose set of values is that of the one given row."""
    row = rows.select("row_idx").limit(2).collect()
    if len(row) != 1:
        raise ValueError("same takes one row")
    return p.table.filter(_equal(p.table, _given(values(rows, prop).select("value")), prop) & (F.col("row_idx") != row[0].row_idx))


@function("diff", ["entity_list", "entity_list", "num_property"], "num")
def diff(p, a, b, prop):
    x = lambda r, n: r.agg(F.max(first(prop)).alias(n))
    return x(a, "a").join(x(b, "b")).select(F.abs(F.col("a") - F.col("b")).cast("double").alias("value"))


END = "END"


@dataclass
class Program:
    table: DataFrame
    names: dict[str, Value] = field(default_factory=dict)
    used: set[str] = field(default_factory=set)
    most: int | None = None  # expressions, after which only the end may follow
    begun: list[str] = field(default_factory=list)  # tokens of the expression that is being read
    ended: bool = False

    def read_token(self, token: str) -> Value | None:
        """Take one token of a program. The one that completes an expression binds its value to the next variable and returns it, END returns the last value."""
        if self.ended:
            raise SyntaxError("the program has ended")
        if token == END:
            if self.begun or not self.names:
                raise SyntaxError("no whole expression to end with")
            self.ended = True
            return list(self.names.values())[-1]
        self.begun.append(token)
        if self.begun.count("(") > self.begun.count(")"):
            return None
        x, self.begun = parse(self.begun), []
        self.names[f"v{len(self.names)}"] = out = self.evaluate(x)
        return out

    def evaluate(self, x) -> Value:
        if isinstance(x, list):
            if not x or x[0] not in FUNCTIONS:
                raise NameError(f"no such function: {x[:1]}")
            f = FUNCTIONS[x[0]]
            given = [self.evaluate(a) for a in x[1:]]
            if len(given) != len(f.args):
                raise TypeError(f"{x[0]} takes {len(f.args)} arguments")
            for a, want in zip(given, f.args, strict=True):
                if want not in ancestors(a.kind):
                    raise TypeError(f"{x[0]} takes {want}, not {a.kind}")
            kind = f.returns if isinstance(f.returns, str) else f.returns(given[-1].data)
            return Value(kind, f.run(self, *[a.data for a in given]))
        if x in self.names:
            self.used.add(x)
            return self.names[x]
        if x == "all_rows":
            return Value("entity_list", self.table)
        if x.startswith("r.") and x in self.table.columns:
            return Value(_type_of(x), x)
        spark = self.table.sparkSession
        try:
            return Value("num_list", spark.createDataFrame([(float(x),)], "value double"))
        except ValueError:
            if re.fullmatch(r"'?([0-9]{4}|xx+)-([0-9]{1,2}|xx)-([0-9]{1,2}|xx)'?", x):
                return Value("datetime_list", spark.createDataFrame([(x.strip("'"),)], "value string"))
            return Value("string_list", spark.createDataFrame([(x.replace("_", " ") if x[:1] != "'" else x.strip("'"),)], "value string"))

    def run(self, text: str) -> Value:
        """Each line is an expression; its value is bound to v0, v1, .. and the last one is the result."""
        out = None
        for k, line in enumerate(line for line in text.split("\n") if line.strip()):
            self.names[f"v{k}"] = out = self.evaluate(parse(tokenize(line)))
        if out is None:
            raise SyntaxError("an empty program")
        return out

    def unused(self) -> set[str]:
        """Variables that nothing uses, without the last one."""
        return set(list(self.names)[:-1]) - self.used

    def valid_tokens(self, began: list[str] | None = None) -> list[str]:
        """What may follow the tokens of an expression that has begun: functions, or variables, rows and properties of the type that is due.

        Without ``began`` what may follow the tokens read so far: between expressions also the end, and at the limit nothing else.
        """
        if self.ended:
            return []
        if began is None:
            began = self.begun
            if not began and self.names:
                return [END] if self.most is not None and len(self.names) >= self.most else ["(", END]
        if not began:
            return ["("]
        if began[-1] == "(":
            return sorted(FUNCTIONS)
        depth, due = 0, []
        for token in began:
            if token == "(":
                depth += 1
                due.append([None, 0])
            elif token == ")":
                due.pop()
                if due:
                    due[-1][1] += 1
            elif due[-1][0] is None:
                due[-1][0] = token
            else:
                due[-1][1] += 1
        if not due:
            return []
        name, given = due[-1]
        if given == len(FUNCTIONS[name].args):
            return [")"]
        want = FUNCTIONS[name].args[given]
        own = [v for v, x in self.names.items() if want in ancestors(x.kind)]
        props = [c for c in self.table.columns if c.startswith("r.") and want in ancestors(_type_of(c))]
        return ["(", *(["all_rows"] if want == "entity_list" else []), *own, *props]

    def connected(self, rows: DataFrame, targets: list | None = None) -> list[str]:
        """Properties whose cell in one of the rows has just the target values, as a set; without targets all that a row can have. One pass over the rows."""
        props = [c for c in rows.columns if c.startswith("r.")]
        if targets is None:
            return props if rows.limit(1).count() else []
        kind = lambda c: rows.schema[c].dataType.elementType.simpleString()
        given = lambda c: F.array_sort(F.array_distinct(F.array(*[F.lit(str(x)).try_cast(kind(c)) for x in targets])))
        found = rows.agg(*[F.bool_or(_equal(rows, given(c), c)).alias(c) for c in props]).first()
        return [c for c in props if found[c]]

    def valid_props(self, rows: DataFrame, asked: list[str], targets: list | None = None) -> list[str]:
        """Those of the asked properties that are connected."""
        own = set(self.connected(rows, targets))
        return [p for p in asked if p in own]

    def next_functions(self, kind: str, rows: DataFrame) -> list[str]:
        """Functions that may follow a value of this type: argmax, mode and aggregates only where there is more than one row."""
        many = rows.limit(2).count() > 1
        single = {"same"}
        several = {"argmax", "argmin", "first", "last", "mode", "maximum", "minimum", "sum", "average", "count"}
        return sorted(n for n, f in FUNCTIONS.items() if f.args[0] in ancestors(kind) and not (n in several and not many) and not (n in single and many))


def as_plain(x: Column) -> Column:
    """A value as it is compared: a number in one way of writing, or lower-case text with single spaces."""
    return F.coalesce(x.try_cast("double").cast("string"), F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))


def near_value(a: Column, b: Column) -> Column:
    """Whether two plain values are equal, numbers within 1e-6."""
    return (a == b) | F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) < 1e-6, F.lit(False))


def met_denotation(targets: Column, predictions: Column) -> Column:
    """``denotation`` as an expression of two arrays of text."""
    a, b = (F.array_distinct(F.transform(c, as_plain)) for c in (targets, predictions))
    return (F.size(a) == F.size(b)) & F.forall(a, lambda x: F.exists(b, lambda y: near_value(x, y)))


def denotation(targets: list, predictions: list) -> bool:
    """As many distinct values, and each target met by a prediction: equal text, numbers within 1e-6, or equal dates."""

    def plain(x):
        try:
            return float(x)
        except (TypeError, ValueError):
            return " ".join(str(x).lower().split())

    def met(a, b):
        return abs(a - b) < 1e-6 if isinstance(a, float) and isinstance(b, float) else a == b

    t, p = {plain(x) for x in targets}, {plain(x) for x in predictions}
    return len(t) == len(p) and all(any(met(a, b) for b in p) for a in t)


def table_of(df: DataFrame, key: str, props: dict[str, tuple[str, str]]) -> DataFrame:
    """A program's table: ``props`` maps r.<name>-<type> to (column, type)."""
    cell = lambda c, kind: F.when(F.col(c).isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.array(F.col(c).cast(kind)))
    return df.select(F.col(key).cast("long").alias("row_idx"), *[cell(c, kind).alias(name) for name, (c, kind) in props.items()])

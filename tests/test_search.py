import itertools

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import program as P
from lakeweave.operators import search as S
from lakeweave.operators import tried as T

PROPS = {"k": "string", "n": "number"}
TABLES = {
    "x": [(["a"], [3.0]), (["b"], [3.0]), (["b", "a"], [1.0]), (["c"], [])],
    "y": [(["ab"], [5.0]), (["b"], [2.0, 7.0])],
    "z": [(["q"], [1.0])],
}
ASKED = {"e1": ("x", ["3", "b"], ["a"]), "e2": ("x", ["1"], ["b", "a"]), "e3": ("y", ["2", "b"], ["7.0000001"]), "e4": ("z", ["q"], [" Q "]), "e5": ("y", [], ["no"])}


def plain(env, depth):
    """All programs of up to so many expressions, one by one, on Python sets."""
    tab, given, answer = ASKED[env]
    table = TABLES[tab]
    cell = lambda r, p: table[r][list(PROPS).index(p)]
    num = lambda g: float(g) if g.lstrip("-").replace(".", "", 1).isdigit() else None

    def steps(rows):
        if len(rows) > 1:
            for g, p in itertools.product(given, PROPS):
                if num(g) is not None and PROPS[p] == "number":
                    for name, test in (("ge", lambda x, y: x >= y), ("greater", lambda x, y: x > y), ("le", lambda x, y: x <= y), ("less", lambda x, y: x < y)):
                        yield f"( filter_{name} {{v}} {g} {p} )", {r for r in rows if any(test(x, num(g)) for x in cell(r, p))}
                    yield f"( filter_eq {{v}} {g} {p} )", {r for r in rows if set(cell(r, p)) == {num(g)}}
                    yield f"( filter_not_eq {{v}} {g} {p} )", {r for r in rows if set(cell(r, p)) != {num(g)}}
                if num(g) is None and PROPS[p] == "string":
                    yield f"( filter_eq {{v}} {g} {p} )", {r for r in rows if set(cell(r, p)) == {g}}
                    yield f"( filter_not_eq {{v}} {g} {p} )", {r for r in rows if set(cell(r, p)) != {g}}
                    yield f"( filter_str_contain_any {{v}} {g} {p} )", {r for r in rows if cell(r, p) and g in cell(r, p)[0]}
                    yield f"( filter_str_contain_not_any {{v}} {g} {p} )", {r for r in rows if cell(r, p) and g not in cell(r, p)[0]}
            for p in PROPS:
                first = {r: cell(r, p)[0] for r in rows if PROPS[p] == "number" and cell(r, p)}
                for name, best in (("argmax", max), ("argmin", min)):
                    if first:
                        yield f"( {name} {{v}} {p} )", {r for r in first if first[r] == best(first.values())}
            yield "( first {v} )", {min(rows)}
            yield "( last {v} )", {max(rows)}
        if rows != set(range(len(table))):
            yield "( next {v} )", {r + 1 for r in rows if r + 1 < len(table)}
            yield "( previous {v} )", {r - 1 for r in rows if r}
        if len(rows) == 1:
            (r,) = rows
            for p in PROPS:
                if cell(r, p):
                    yield f"( same {{v}} {p} )", {x for x in range(len(table)) if x != r and set(cell(x, p)) == set(cell(r, p))}

    def ends(rows):
        for p, kind in PROPS.items():
            bag = [x for r in rows for x in cell(r, p)]
            yield f"( hop {{v}} {p} )", bag
            if len(rows) > 1 and bag:
                most = max(bag.count(x) for x in bag)
                yield f"( mode {{v}} {p} )", [x for x in bag if bag.count(x) == most]
                if kind == "number":
                    yield from ((f"( {n} {{v}} {p} )", [v]) for n, v in (("maximum", max(bag)), ("minimum", min(bag)), ("sum", sum(bag)), ("average", sum(bag) / len(bag))))
        if len(rows) > 1:
            yield "( count {v} )", [len(rows)]

    out, level = set(), [([], set(range(len(table))))]
    for d in range(depth):
        named = lambda path: "\n".join(x.replace("{v}", "all_rows" if i == 0 else f"v{i - 1}") for i, x in enumerate(path))
        out |= {named([*path, op]) for path, rows in level for op, found in ends(rows) if found and P.denotation(answer, found)}
        level = [([*path, op], found) for path, rows in level for op, found in steps(rows) if found and found != rows]
    return out


def questions(spark):
    cells = [(tab, r, p, kind, [str(x) for x in row[i]], [float(x) if kind == "number" else None for x in row[i]]) for tab, rows in TABLES.items() for r, row in enumerate(rows) for i, (p, kind) in enumerate(PROPS.items())]
    return S.Questions(
        spark.createDataFrame(cells, "tab string, row long, prop string, kind string, texts array<string>, nums array<double>"),
        spark.createDataFrame([(e, x[0]) for e, x in ASKED.items()], "env string, tab string"),
        spark.createDataFrame([(e, g) for e, x in ASKED.items() for g in x[1]], "env string, value string"),
        spark.createDataFrame([(e, a) for e, x in ASKED.items() for a in x[2]], "env string, value string"),
    )


@pytest.mark.parametrize("depth", [1, 3])
def test_search_equals_enumeration(spark, depth):
    got = [(x.env, x.program, x.n_expressions) for x in S.search(questions(spark), depth).collect()]
    want = {(e, p) for e in ASKED for p in plain(e, depth)}
    assert sorted(x[:2] for x in got) == sorted(want)
    assert all(n == p.count("\n") + 1 for _, p, n in got)
    assert {e for e, _ in want} >= ({"e2", "e4"} if depth == 1 else {"e1", "e2", "e4"})


def test_denotation_expression_equals_the_function(spark):
    cases = [(["a", "2"], ["2.0", "A"]), (["a"], ["a", "b"]), (["1.0000001"], ["1"]), (["x y"], [" X  Y "]), (["5"], ["6"]), ([], []), (["a", "a"], ["a"])]
    got = spark.createDataFrame(cases, "t array<string>, p array<string>").select(P.met_denotation(F.col("t"), F.col("p")).alias("m")).collect()
    assert [x.m for x in got] == [P.denotation(t, p) for t, p in cases]


@pytest.mark.parametrize("expected", [1, 10_000])
def test_tried_counts_equal_an_exact_set(spark, expected):
    """A filter of one word answers maybe for all; the exact table decides."""
    rows = [(r, f"p{(7 * i * (r + 1)) % 90}") for r in range(4) for i in range(40)]
    got = {x["round"]: (x.proposed, x.tried, x.new) for x in T.rounds(spark.createDataFrame(rows, "r int, p string"), "r", "p", expected).collect()}
    seen, want = set(), {}
    for r in range(4):
        own = [p for k, p in rows if k == r]
        want[r] = (len(own), sum(p in seen for p in own), len(set(own) - seen))
        seen |= set(own)
    assert got == want


def test_filters_merge(spark):
    a, b = (spark.createDataFrame([(f"{n}{i}",) for i in range(50)], "k string") for n in "ab")
    both = T.merged(T.bloom(a, "k", 16), T.bloom(b, "k", 16))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, T.bloom(a.union(b), "k", 16).collect()))

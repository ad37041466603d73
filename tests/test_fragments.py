"""Fragments against their definition, and small cases of what the queries use."""

import pytest

from lakeweave.functions import metrics as M
from lakeweave.functions import serialise as S
from lakeweave.operators import fragments as FR
from lakeweave.operators import models, program, ranks
from lakeweave.sources import readers as R
from lakeweave.sources import writers as W

ROWS, COLS = 60, 7


@pytest.fixture(scope="module")
def parent(spark):
    cells = [(t, r, c, f"Col {c}", f"{t} {r} {c}") for t in ("one", "two") for r in range(ROWS) for c in range(COLS)]
    cells += [("thin", r, c, f"Col {c}", "x") for r in range(ROWS) for c in range(4)] + [("short", r, c, f"Col {c}", "x") for r in range(5) for c in range(COLS)]
    cells = spark.createDataFrame(cells, "table_id string, row_idx long, col_idx int, col string, value string")
    return cells, spark.createDataFrame([("one", 0), ("two", 3), ("thin", 0), ("short", 0)], "table_id string, key_idx int")


@pytest.mark.parametrize("tier", range(4))
def test_fragments(spark, parent, tier):
    got = {}
    for r in FR.fragments(*parent, tier).collect():
        got.setdefault((r.table_id, r.kind), []).append(r)
    assert set(got) == {(t, k) for t in ("one", "two") for k in ("seed", "union", "join")}  # the others are too small
    for t, key in (("one", 0), ("two", 3)):
        rows = {k: {r.row_parent for r in got[t, k]} - {-1} for k in ("seed", "union", "join")}
        cols = {k: {r.col_parent for r in got[t, k]} - {-1} for k in ("seed", "union", "join")}
        assert not rows["seed"] & rows["union"] and rows["seed"] | rows["union"] == rows["join"] == set(range(ROWS))
        assert 0.6 * ROWS - 1 <= len(rows["seed"]) <= 0.8 * ROWS + 1
        assert cols["seed"] == cols["union"] and cols["seed"] & cols["join"] == {key} and cols["seed"] | cols["join"] == set(range(COLS))
        assert 3 <= len(cols["seed"]) <= 4
        for kind in ("seed", "union", "join"):
            own = got[t, kind]
            high, wide = max(r.row_idx for r in own) + 1, max(r.col_idx for r in own) + 1
            assert sorted((r.row_idx, r.col_idx) for r in own) == [(i, j) for i in range(high) for j in range(wide)]  # whole, and nothing twice
            new_rows, new_cols = high - len(rows[kind]), wide - len(cols[kind])
            assert (2 <= new_rows <= 5 and 1 <= new_cols <= 2) if tier == 3 and kind != "seed" else new_rows == new_cols == 0
            spoilt = [r for r in own if r.row_parent >= 0 and r.col_parent >= 0 and r.value != f"{t} {r.row_parent} {r.col_parent}"]
            assert not spoilt if tier < 2 or kind == "seed" else len(spoilt) < 0.3 * len(own)
            if tier < 3:
                assert not [r for r in spoilt if r.is_key]
            if tier == 0 or kind == "seed":
                assert all(r.col == f"Col {r.col_parent}" for r in own)
                assert [p for _, p in sorted({(r.row_idx, r.row_parent) for r in own})] == sorted(rows[kind])
            values = {}
            for r in own:
                values.setdefault((r.col_idx, r.col_parent), []).append(r.value)
            for (_, p), v in values.items():
                if p == -1:  # another column in another order
                    assert sorted(v) in [sorted(w) for (_, q), w in values.items() if q >= 0]


def test_noise_of_cells_keys_and_names(spark):
    from pyspark.sql import functions as F

    from lakeweave.operators import prepare as P

    rows = spark.createDataFrame([("abcde",), ("a",), ("ab",), ("",), (None,), ("a B_c ",)], "x string").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(59))))
    got = rows.select("x", "r", P.spoilt_cell(F.col("x"), F.col("r")).alias("c"), P.spoilt_key(F.col("x"), F.col("r")).alias("k"), P.renamed(F.col("x"), F.col("r")).alias("n")).collect()

    def swap(x, r):
        i = r % max(len(x) - 1, 1)
        return x if len(x) < 2 else x[:i] + x[i + 1] + x[i] + x[i + 2 :]

    for g in got:
        x, r = g.x, g.r
        if x is None:
            assert (g.c, g.k, g.n) == (None, None, None)
            continue
        assert g.c == ["", swap(x, r // 3), x if len(x) < 3 else x[: len(x) // 2]][r % 3]
        assert g.k == [swap(x, r // 3), x + " ", x if len(x) < 2 else x[:-1]][r % 3] and (g.k or not x)
        assert g.n == [x.lower(), x.upper(), x.replace(" ", "_"), x.replace("_", " "), x.rstrip(" ") + " "][r % 5]


def test_manifest(parent):
    rows = {(r.table_id, r.kind): r for r in FR.manifest(FR.fragments(*parent, 0)).collect()}
    assert rows["two", "seed"].role == "query" and rows["two", "join"].role == "lake"
    assert rows["two", "join"].key_col == "Col 3" and rows["two", "join"].n_rows == ROWS
    assert rows["one", "seed"].n_rows + rows["one", "union"].n_rows == ROWS


def test_no_parents(parent):
    cells, keys = parent
    assert FR.fragments(cells.limit(0), keys, 3).count() == 0


def test_placed(spark):
    df = spark.createDataFrame([(g, (i * 7919 % 101) << 14, i) for g in "ab" for i in range(200)], "g string, h long, i int")
    for by in ([], ["g"]):
        rows = ranks.placed(df, "h", ["g", "i"], "at", by).collect()
        for g in "ab" if by else [None]:
            own = sorted((r for r in rows if g is None or r.g == g), key=lambda r: r["at"])
            assert [r["at"] for r in own] == list(range(len(own)))
            assert [(r.h, r.g, r.i) for r in own] == sorted((r.h, r.g, r.i) for r in own)


def test_connected(spark):
    df = spark.createDataFrame([(0, ["a", "b"], [1.0]), (1, ["b"], [2.0]), (2, [], [])], "row_idx long, `r.x-string` array<string>, `r.n-number` array<double>")
    p = program.Program(df)
    assert p.connected(df, ["b", "a"]) == ["r.x-string"]
    assert p.connected(df, ["2"]) == ["r.n-number"]
    assert p.connected(df, ["c"]) == []
    assert p.connected(df) == ["r.x-string", "r.n-number"]
    assert p.connected(df.limit(0)) == []
    assert p.valid_props(df, ["r.n-number"], ["b"]) == []


def test_valid_examples(spark):
    kind = "id int, header array<struct<name: string, name_tokens: array<string>>>"
    rows = [(0, [("a b", ["a", "b"])]), (1, [("a " * 10 + "b", ["a"])]), (2, [("a", [])]), (3, [("a", None)]), (4, [])]
    assert sorted(r.id for r in R.valid_examples(spark.createDataFrame(rows, kind)).collect()) == [0, 4]


def test_cleaned_target_and_trees(spark):
    df = spark.createDataFrame([("1,234%",), ("x",), (None,), ("NaN",), ("-2",)], "y string")
    assert [r[0] for r in df.select(models.cleaned_target(df.y)).collect()] == [1234.0, None, None, None, -2.0]
    data = spark.createDataFrame([(i, [float(i % 10), 1.0], f"{i % 10}%") for i in range(200)], "k int, v array<double>, y string")
    out = models.boosted_probe(data, "k", "v", "y").first()
    assert out.n == 40 and out.mse < 0.001
    with pytest.raises(ValueError):
        models.boosted_probe(data.limit(3), "k", "v", "y")


def test_pmi_sample(spark):
    rows = [("t", 0, "p q", "x"), ("t", 1, "p q", "x"), ("t", 2, "r p", "y"), ("u", 0, "p q", "y"), ("u", 1, None, "y")]
    df = spark.createDataFrame(rows, "t string, o int, a string, v string")
    # n(r p, y) / (1 * 2) = 1/2, n(p q, x) / (3 * 2) = 1/3, n(p q, y) / (3 * 2) = 1/6
    got = {(r.t, r.place): r.token for r in S.pmi_sample(df, "t", "o", "a", "v", 9, of_topic=True).collect()}
    assert got == {("t", 1): "r", ("t", 2): "p", ("t", 3): "q", ("u", 1): "p", ("u", 2): "q"}
    short = [r.token for r in S.pmi_sample(df, "t", "o", "a", "v", 1, of_topic=True).orderBy("t", "place").collect()]
    assert short == ["r", "p", "p", "q"]  # a value's words go in whole


def test_numbered_and_shards(spark):
    df = spark.createDataFrame([(f"n{i:03}",) for i in range(10)], "name string")
    assert [r.at for r in ranks.numbered(df, "name", "at").orderBy("name").collect()] == list(range(10))
    assert [r.shard for r in W.shards_of(df, "name", 4).orderBy("name").collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
    assert [r.shard for r in W.shards_of(df.limit(2), "name", 4).orderBy("name").collect()] == [1, 2]
    assert W.shards_of(df.limit(0), "name", 4).count() == 0
    clash = spark.createDataFrame([(3, 0.5, 1), (1, 0.5, 0)], "n int, before double, y int")
    assert {r.n: r.at for r in ranks.numbered(clash, "n", "at").collect()} == {1: 0, 3: 1}
    assert M.threshold_probe(clash, "y", "n").first().threshold == 2.0
    assert M.average_rank(clash, "n", "r").count() == 2


def test_no_threshold(spark):
    assert M.threshold_probe(spark.createDataFrame([], "y int, s double"), "y", "s").count() == 0
    one = M.threshold_probe(spark.createDataFrame([(1, 0.5), (0, None)], "y int, s double"), "y", "s").first()
    assert (one.threshold, one.f1) == (0.49, 1.0)

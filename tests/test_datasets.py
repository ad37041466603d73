import json

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import generate as G
from lakeweave.sources import datasets as D


def test_layouts(spark, tmp_path):
    body = "x,y\n" + "\n".join(f"{i},{i % 2}" for i in range(20)) + "\n"
    for name in ("one", "split", "two"):
        (tmp_path / name).mkdir()
    (tmp_path / "one/data.csv").write_text(body)
    (tmp_path / "split/data.csv").write_text(body)
    (tmp_path / "split/splits.json").write_text("\n".join(json.dumps({"split": "train" if i < 15 else "test", "row_idx": i}) for i in range(20)))
    (tmp_path / "two/train.csv").write_text(body)
    (tmp_path / "two/test.csv").write_text("x,y\n100,1\n")
    one = D.load(spark, str(tmp_path / "one"), ["y"])
    assert sorted((r.row_idx, r.x) for r in one.split("all").collect()) == [(i, i) for i in range(20)]
    assert D.load(spark, str(tmp_path / "split"), ["y"]).split("test", features_only=True).columns == ["row_idx", "x"]
    assert D.load(spark, str(tmp_path / "split"), ["y"]).split("test").count() == 5
    two = D.load(spark, str(tmp_path / "two"), ["y"])
    assert [r.x for r in two.split("test").collect()] == [100] and two.task("y") == "classification"


def test_vectors_with_labels(spark):
    labels = spark.createDataFrame([("1", 0, "a"), ("t", 1, "b")], "table_id string, col_idx int, class string")
    v = spark.createDataFrame([("table_1", 0, [1.0, 2.0])], "table_id string, col_idx int, v array<float>")
    got = {r.table_id: (r.v, r.mask, r.one_hot) for r in D.with_vectors(labels, v, 2, ["a", "b"]).collect()}
    assert got == {"table_1": ([1.0, 2.0], 1, [1, 0]), "t": ([0.0, 0.0], 0, [0, 1])}
    assert spark.range(1).select(D.natural_columns(F.array(*map(F.lit, ["b", "10", "9", "a"]))).alias("x")).first().x == ["9", "10", "a", "b"]


def test_encodings(spark, tmp_path):
    for name, data, want in (("a", "é".encode(), "utf-8"), ("b", "é".encode("latin-1") + b" plain text", "latin-1"), ("c", "x".encode("utf-16"), "utf-16")):
        (tmp_path / name).write_bytes(data)
        assert D.sniff_encoding(spark, str(tmp_path / name)) == want


def test_synthetic_rows(spark):
    a = G.row_table(spark, 2000, 4, 0.5, 5, 0.1)
    b = G.row_table(spark, 2000, 4, 0.5, 5, 0.1).repartition(7)
    assert a.exceptAll(b).count() == 0
    s = a.agg(F.avg("f2").alias("m"), F.stddev("f2").alias("d"), F.avg(F.col("f3").isNull().cast("int")).alias("miss")).first()
    assert abs(s.m) < 0.1 and abs(s.d - 1) < 0.1 and abs(s.miss - 0.1) < 0.03
    n = {r.f0: r["count"] for r in a.filter("f0 is not null").groupBy("f0").count().collect()}
    assert set(n) == {f"c{i}" for i in range(5)} and n["c0"] > n["c4"]
    sw = G.sweep(spark, {"rows": 10, "cols": 4}, {"rows": [5, 20], "cols": [8]})
    assert {(r.id, r.rows, r.cols) for r in sw.collect()} == {("rows_5", 5, 4), ("rows_20", 20, 4), ("cols_8", 10, 8)}
    assert sw.select(G.sweep_level(F.col("id")).alias("s")).filter("s.level is null").count() == 0
    v = G.random_vectors(spark.createDataFrame([(1, [0.0] * 30)], "k long, v array<float>"), "k", "v").first().v
    assert len(v) == 30 and len(set(v)) == 30


@pytest.mark.parametrize("how", ["drop_col", "sample_row", "drop_cell", "drop_nan_col", "drop_num_cell", "drop_num_col", "drop_head_cell", "shuffle_row", "shuffle_col", "replace_cell", "swap_cell"])
def test_augmentations(spark, how):
    rows = [("t", i, c, v) for i in range(30) for c, v in (("a", f"x{i % 7}"), ("b", str(i)), ("c", None), ("d", f"y{i}"))]
    cells = spark.createDataFrame(rows, "table_id string, row_idx long, col string, value string")
    out = G.augment(cells, how, 30)
    got = out.collect()
    assert out.columns == cells.columns and len(got) <= len(rows)
    if how == "drop_nan_col":
        assert {r.col for r in got} == {"a", "b", "d"}
    if how == "drop_num_col":
        assert {r.col for r in got} == {"a", "c", "d"}
    if how.startswith("shuffle"):
        assert len(got) == len(rows) and sorted(str(r.value) for r in got) == sorted(str(r[3]) for r in rows)
    if how in ("replace_cell", "swap_cell"):
        for c in "abd":
            assert {r.value for r in got if r.col == c} <= {r[3] for r in rows if r[2] == c}

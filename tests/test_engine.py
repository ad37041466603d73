import json

import pytest
from pyspark.sql import functions as F

from lakeweave.functions import cleaning as C
from lakeweave.functions import metrics as M
from lakeweave.functions import vectors as V
from lakeweave.operators import enrichment, lake, prepare, vector_join
from lakeweave.sources import lake_files, readers, writers
from lakeweave.streaming import incremental


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_null_vocabularies(spark):
    df = spark.createDataFrame([(" NA ",), ("--",), ("",), ("None",), ("x",), ("\t y\n",)], "v string")
    keep = lambda nulls: [x.v for x in df.select(C.normalize_value(F.col("v"), nulls).alias("v")).collect() if x.v is not None]
    assert keep(C.OVERLAP_NULLS) == ["--", "x", " y"]
    assert keep(C.TFIDF_NULLS) == ["x", " y"]
    assert keep(C.ENRICH_NULLS) == ["na", "--", "x", " y"]


def test_names_and_escapes(spark):
    assert one(spark, C.file_stem(F.lit("a/b/c.csv.gz"))) == "c"
    assert one(spark, C.csv_escape(F.lit('a"b'))) == '"a""b"'
    assert one(spark, C.tsv_unescape(F.lit("a\\nb\\pc\\\\n"))) == "a\nb|c\\n"
    assert one(spark, C.number(F.lit("$1,200%"))) == 1200.0
    assert one(spark, C.safe_file_name(F.lit("a b/c"))) == "a_b_c"
    assert one(spark, C.url_kind(F.lit("http://x.org/d/abcd-1234"))) == "socrata"


def test_partial_dates(spark):
    d = lambda x: C.partial_date(F.lit(x))
    month = [one(spark, C.date_compare(d(x), d("xx-05-xx"), ">=")) for x in ("1999-05-xx", "2001-xx-xx", "2000-12-31")]
    assert month == [True, False, True]
    assert one(spark, d("1999-13-01")) is None and one(spark, d("x")) is None


def test_containment_fixture(spark):
    rows = [("q", "c", v) for v in "abcd"] + [("c1", "c", v) for v in "ab"] + [("c2", "c", v) for v in "abcde"] + [("q", "c3", v) for v in "abcd"]
    lakes = spark.createDataFrame(rows, "table_id string, col string, value string")
    got = [(x.table_id, x.containment) for x in lake.containment_join(lakes.filter("table_id = 'q' and col = 'c'"), lakes, 5).orderBy("rank").collect()]
    assert got == [("c2", 1.0), ("c1", 0.5)]


def test_multiset_f1_fixture(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "v string") for xs in ("xxy", "xyz"))
    r = lake.multiset_f1(a, b, "v").first()
    assert (r.tp, r.precision, r.recall, r.f1) == (2, 0.666667, 0.666667, 0.666667)


def test_ranked_fixture(spark):
    results = spark.createDataFrame([("q", f"r{i}", i) for i in range(1, 5)], "qid string, cid string, rank int")
    truth = spark.createDataFrame([("q", "r2"), ("q", "r4")], "qid string, cid string")
    r = M.ranked(results, truth)
    assert M.join_prf_at_k(r, 2).first().precision == 0.5
    assert M.average_precision(r).first().ap == 0.5
    alone = M.ranked(results.filter("rank = 2").withColumn("rank", F.lit(1)), truth)
    assert M.join_prf_at_k(alone, 10).first().precision == 1.0
    assert M.union_map(alone, 10).filter("k = 10").first().precision == 0.1
    recalls = [M.join_prf_at_k(r, k).first().recall for k in range(1, 5)]
    assert recalls == sorted(recalls)


def test_threshold_and_metrics(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.8, 1)], "s double, y int")
    assert M.threshold_probe(df, "y", "s").first().threshold == 0.25
    assert M.auroc(df, "y", "s").first().auroc == 1.0
    assert M.auroc(df.filter("y = 1"), "y", "s").first().auroc == 0.5
    p = spark.createDataFrame([("c1", "A"), ("c1", "A"), ("c1", "B"), ("c2", "B"), ("c2", "B")], "c string, l string")
    assert M.purity(p, "c", "l").first().purity == 0.8
    assert set(M.METRICS) >= {"f1_macro", "auroc", "nmi"}


def test_vectors(spark):
    assert one(spark, V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, V.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, V.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0)))) == 0.0
    assert one(spark, V.combine(F.array(F.lit(1.0)), F.array(F.lit(3.0)), "weighted", 0.25)) == [2.5]


def test_vector_join_in_blocks(spark, monkeypatch):
    rows = [(i, i % 3, [float(i % 5), 1.0, float(i % 7)]) for i in range(40)]
    q, c = spark.createDataFrame(rows, "qid long, qgroup int, v array<float>"), spark.createDataFrame(rows, "cid long, cgroup int, v array<float>")
    whole = sorted(map(tuple, vector_join.cosine_join(q, c, k=4).collect()))
    monkeypatch.setattr(vector_join, "MAX_QUERIES", 7)
    assert sorted(map(tuple, vector_join.cosine_join(q, c, k=4).collect())) == whole
    assert vector_join.cosine_join(q.limit(0), c, k=4).count() == 0
    assert all(x.qgroup != x.cgroup for x in vector_join.cosine_join(q, c, threshold=0.9).collect())


def test_identity_enrichment_has_f1_1(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert enrichment.cell_f1(t, t, ["k", "v"], ["k", "v"]).first().f1 == 1.0
    out = enrichment.enrich_table(t, t.withColumn("k", F.col("k") + 1), t.withColumn("v", F.lit("z")), {"k": "k", "v": "v"}, "k", "k")
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a", "z"), (2, "b", "z"), (3, "b", None)]


def test_splits_and_bins(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 50)
    s = prepare.hash_split(df, "g", {"a": 0.5, "b": 0.5})
    assert s.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert sorted(x["count"] for x in prepare.exact_split(df, "id", {"a": 20, "b": 80}).groupBy("split").count().collect()) == [20, 80]
    assert prepare.quantile_bins(df.withColumn("x", F.col("id") % 3), "x", 10).select("bin").distinct().count() == 3
    fit, new = df.filter("id < 10"), spark.createDataFrame([(99, "x"), (1, "1")], "id long, g string")
    assert [x.g for x in prepare.ordinal(new, "g", fit_on=fit).orderBy("id").collect()] == [1, -1]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,QTY,Unnamed: 2\n1E1032981008100,5,\nNA,6,\n")
    typed = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert typed.dtypes == [("ID", "string"), ("QTY", "int")]
    assert typed.first().ID == "1E1032981008100"
    assert [x.ID for x in readers.read_csv(spark, str(tmp_path / "a.csv"), text=True).collect()] == ["1E1032981008100", "NA"]
    lakes = tmp_path / "lake"
    lakes.mkdir()
    (lakes / "x.csv").write_text("a,a,b\n1,2,3\n4,5,6,7\n8\n")
    (lakes / "y.csv").write_bytes(b"\xff\xfe\x00bad")
    got = {(x.table_id, x.row_idx, x.col): x.value for x in lake_files.read_lake(spark, str(lakes)).collect()}
    assert got == {("x.csv", 0, "a"): "1", ("x.csv", 0, "a_1"): "2", ("x.csv", 0, "b"): "3", ("x.csv", 1, "a"): "4", ("x.csv", 1, "a_1"): "5", ("x.csv", 1, "b"): "6", ("x.csv", 2, "a"): "8"}
    (tmp_path / "allow.txt").write_text("# no\n\n a \nb\n")
    assert [x.name for x in readers.read_allow_list(spark, str(tmp_path / "allow.txt")).collect()] == ["a", "b"]
    assert len(readers.fingerprint(spark, str(tmp_path / "a.csv"))) == 64


def test_records(spark):
    r = spark.createDataFrame([(1, '{"b": "1", "a": "2"}'), (2, '{"a": "2", "b": "1"}'), (3, '{"c": "3"}')], "seq long, j string")
    assert readers.records_to_table(r, "j", "seq").columns == ["seq", "b", "a", "c"]
    assert readers.dedup_records(r, "j", "seq").count() == 2
    p = spark.createDataFrame([("a", "1", "b", "2"), ("a", "1", "c", "3")], "table_a_id string, table_a_csv string, table_b_id string, table_b_csv string")
    assert readers.pairs_to_tables(p).count() == 3
    with pytest.raises(ValueError):
        readers.pairs_to_tables(p.union(p.selectExpr("'a'", "'other'", "'d'", "'4'")))
    feed = spark.createDataFrame([("x", '{"a": 1}'), ("y", "{}")], "record_type string, record_json string")
    assert readers.route(feed, "x", "a int").collect()[0].a == 1


def test_vectors_round_trip(spark, tmp_path):
    line = readers.from_legacy([{"table": "t", "columns": {"1": [1, 2], "0": [3, 4]}}])
    (tmp_path / "v.jsonl").write_text(line)
    df = readers.read_vector_json(spark, str(tmp_path / "v.jsonl")).withColumn("split", F.lit("train"))
    writers.write_vectors(df, str(tmp_path / "out"), ["split"])
    back = readers.columns_of(readers.read_vectors(spark, str(tmp_path / "out")))
    assert {(x.name, tuple(x.v)) for x in back.collect()} == {("0", (3.0, 4.0)), ("1", (1.0, 2.0))}
    assert readers.table_vector(df, "column_mean").count() == 0
    assert json.loads(line)["version"] == "2.0"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1, "x"), ("a", 1, 0, "y"), ("b", 0, 0, "z")], "id string, shard int, pos int, v string")
    assert {(x.id, x.v) for x in writers.merge_shards(df, "id", ["shard", "pos"]).collect()} == {("a", "y"), ("b", "z")}
    flat = writers.flatten(df.select("id", F.struct("shard", "pos").alias("at")))
    assert flat.columns == ["id", "at_shard", "at_pos"]
    writers.write_table(flat, str(tmp_path / "t"), ["id"], single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 3
    writers.write_sketches(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 3
    names = writers.shards_of(spark.createDataFrame([(c,) for c in "abcdefg"], "n string"), "n", 3).groupBy("shard").count().orderBy("shard")
    assert [x["count"] for x in names.collect()] == [3, 2, 2]


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = lambda: incremental.read_events(spark, str(tmp_path / "in"), schema)
    batch = e.withColumn("ts", F.col("ts").cast("timestamp"))
    got = incremental.run_once(incremental.rolling_metrics(stream(), ["event_type"], "value"), "m", "complete", str(tmp_path / "c1"))
    want = batch.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert got.count() == want.count() and got.agg(F.sum("n")).first()[0] == e.count()
    got = incremental.run_once(incremental.posting_counts(stream(), "event_type"), "p", "complete", str(tmp_path / "c2"))
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in batch.groupBy("event_type").count().collect()}
    got = incremental.run_once(incremental.latest(stream().select("user_id", "ts", "event_id"), "user_id"), "l", "complete", str(tmp_path / "c3"))
    assert got.count() == batch.select("user_id").distinct().count()
    got = incremental.run_once(incremental.first_within(stream(), "event_id"), "f", "append", str(tmp_path / "c4"))
    assert got.count() == e.count()

import random

from pyspark.sql import functions as F

from lakeweave.streaming import keyed


def stream(spark, path, rows, schema, files):
    """Files in a fixed order, one to a batch."""
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_last_record_wins_whatever_the_order(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "c", None]), r.randint(0, 3), r.randint(0, 50), float(i)) for i in range(200)]
    schema = "key string, first long, second long, value double"
    got = keyed.run_to_table(keyed.last_wins(stream(spark, str(tmp_path / "in"), rows, schema, 4)), ["key"]).collect()
    want = {}
    for k, a, b, _ in rows:
        want[k] = max(want.get(k, (-1, -1)), (a, b))
    assert {x.key: (x.first, x.second) for x in got} == want and not any(x.closed for x in got)


def test_a_quiet_key_is_let_go(spark, tmp_path):
    schema = "key string, first long, second long, value double, ts timestamp_ntz"
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    batches = [[("a", 1, 1, 1.0, start)], [("b", 1, 1, 2.0, start + timedelta(days=10))], [("b", 1, 2, 3.0, start + timedelta(days=20))], [("b", 1, 3, 4.0, start + timedelta(days=21))]]
    path = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    got = {x.key: x for x in keyed.run_to_table(keyed.last_wins(rows, 86_400_000), ["key"]).collect()}
    assert got["a"].closed and got["a"].value == 1.0
    assert got["b"].value in (3.0, 4.0)


def test_postings_grow_as_a_batch_would_have_them(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.randint(0, 30), r.choice("xyz"), 1) for _ in range(300)]
    out = keyed.run_to_table(keyed.postings(stream(spark, str(tmp_path / "in"), rows, "did long, w string, tf long", 3), 2), ["w", "part"])
    got = {x.w: (x.df, x.ctf) for x in out.groupBy("w").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf")).collect()}
    assert got == {w: (len({d for d, x, _ in rows if x == w}), sum(x == w for _, x, _ in rows)) for w in "xyz"}

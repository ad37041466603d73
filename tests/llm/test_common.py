import os
import threading

from pyspark.sql import functions as F

from lakeweave.llm import mixing, near_dedup
from lakeweave.llm._common import scratch, stash


def files(df):
    return os.path.isdir(df._lakeweave_path.removeprefix("file:"))


def test_blocks_in_two_threads_leave_each_others_tables(spark):
    begun, ended, seen = threading.Event(), threading.Event(), []

    def other():
        begun.wait()
        with scratch():
            stash(spark.range(2))
        ended.set()

    t = threading.Thread(target=other)
    t.start()
    with scratch() as keep:
        with scratch() as inner:
            kept = inner(stash(spark.range(3)))
            gone = stash(spark.range(4))
        begun.set()
        ended.wait()
        seen.append((files(kept), files(gone)))
        last = keep(stash(spark.range(5)))
    t.join()
    assert seen == [(True, False)] and not files(kept) and files(last) and last.count() == 5


def test_rows_with_maps_are_mixed(spark):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.create_map(F.lit("k"), F.col("id")).alias("m"), F.array(F.create_map("id", "id")).alias("n"))
    got = mixing.mix(docs).select("doc_id", F.col("m")["k"].alias("k")).collect()
    assert {x.doc_id for x in got} == set(range(30)) and all(x.doc_id == x.k for x in got)


def test_a_large_group_of_copies_and_its_near_copies(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(1_300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 13 == 0, F.concat(F.lit(text), F.lit(" x"), F.floor(F.col("id") / 13))).otherwise(F.lit(text)).alias("text"))
    got = near_dedup.near_dedup(docs).groupBy("component_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).collect()
    assert [tuple(x) for x in got] == [(0, 1_300, 1)]

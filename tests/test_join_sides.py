"""Tables of cells and rows are not broadcast, however small Spark takes them to be."""

from pyspark.sql import functions as F

from lakeweave.operators import fragments, ranks
from lakeweave.plans import fragment_queries as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_are_shuffled(spark):
    x = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 70_000 % 1_000_003).alias("roll"))
    placed = ranks.placed(x, "roll", ["id"], "place", ["g"])
    assert "BroadcastHashJoin" not in plan(placed)
    want = sorted((r.g, r.roll, r.id) for r in x.collect())
    assert [(r.g, r.roll, r.id) for r in sorted(placed.collect(), key=lambda r: (r.g, r.place))] == want


def test_beside(spark):
    x, few = spark.range(100).select("id", (F.col("id") % 7).alias("g")), spark.range(7).select(F.col("id").alias("g"), (F.col("id") * 10).alias("w"))
    for most, name in ((7, "BroadcastHashJoin"), (6, "SortMergeJoin")):
        both = x.join(ranks.beside(few, most), "g")
        assert name in plan(both) and sorted(map(tuple, both.collect())) == sorted((i % 7, i, i % 7 * 10) for i in range(100))


def test_cells_of_fragments_are_not_broadcast(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    for tier in (0, 3):
        p = plan(fragments.fragments(*Q.parents(read), tier))
        assert "SortMergeJoin" in p and "Inner, BuildLeft" not in p

"""components join stars of tasks, so that a driver has few jobs to plan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.operators import graph
from lakeweave.operators.near_pairs import near_pairs


def plain(edges):
    up = {n: n for e in edges for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in up}


@pytest.fixture(scope="module")
def edges():
    """A path in odd order, random edges, a loop and edges given twice."""
    r = random.Random(3)
    path = [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(30)]
    return [*path, *((r.randrange(500, 900), r.randrange(500, 900)) for _ in range(60)), (1_000, 1_000), *path[:9]]


@pytest.mark.parametrize("most", [graph.MOST, 50])
def test_components_by_one_task_and_by_rounds(spark, tmp_path, monkeypatch, edges, most):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(graph, "MOST", most)
    got = graph.components(spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long").repartition(7)).collect()
    assert {x.node: x.comp for x in got} == plain(edges) and len(got) == len(plain(edges))
    names = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "a string, b string")
    assert {x.node: x.comp for x in graph.components(names).collect()} == plain([(str(a), str(b)) for a, b in edges])


def test_few_jobs(spark, tmp_path, edges):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("components", "")
    try:
        graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
        capped = graph.capped_components(spark.createDataFrame([(a, b, 0.5) for a, b in edges], "a long, b long, sim double"), 5)
        assert capped.groupBy("cluster").count().agg(F.max("count")).first()[0] <= 5
        assert len(tracker.getJobIdsForGroup("components")) <= 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("size", [None, 50])
def test_blocks_of_near_vectors_leave_a_forest(spark, tmp_path, size):
    """120 equal vectors have 7,140 pairs."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    m = np.random.default_rng(1).normal(size=(200, 6))
    m[40:160] = m[40]
    q = spark.createDataFrame([(i, i, x.tolist()) for i, x in enumerate(m)], "qid long, qgroup long, v array<double>")
    c = q.withColumnsRenamed({"qid": "cid", "qgroup": "cgroup"})
    every = near_pairs(q, c, threshold=0.8, ordered=True, size=size).cache()
    few = near_pairs(q, c, threshold=0.8, ordered=True, size=size, forest=True).cache()
    assert every.count() > 7_000 and few.count() < (400 if size is None else 10 * 200)
    assert few.exceptAll(every).count() == 0
    comps = lambda p: {x.node: x.comp for x in graph.components(p.select(F.col("qid").alias("a"), F.col("cid").alias("b"))).collect()}
    assert comps(few) == comps(every) == plain([(x.qid, x.cid) for x in every.collect()])

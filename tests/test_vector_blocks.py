"""Pairs of tables by blocks against the operators on rows of pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lakeweave.functions import vectors as V
from lakeweave.operators import vector_blocks as B
from lakeweave.operators import vector_join as J
from lakeweave.plans import vector_queries as Q


@pytest.fixture(scope="module")
def sides(spark):
    """Two pairs of tables and one table alone; ties, a zero vector, null ones and one of another length."""
    r = random.Random(5)
    rows = [(i, i % 5, [round(r.gauss(0, 1), 1) for _ in range(3)]) for i in range(120)]
    odd = {7: None, 10: [0.0, 0.0, 0.0], 11: rows[16][2], 20: [1.0, None, 2.0], 23: [1.0, 2.0], 30: None}
    e = spark.createDataFrame([(i, g, odd.get(i, v)) for i, g, v in rows], "id long, g int, v array<double>")
    q = e.filter("g % 2 = 0").select(F.col("id").alias("qid"), F.col("g").alias("pair"), "v")
    return q, e.select(F.col("id").alias("cid"), (F.col("g") - 1).alias("pair"), "v")


@pytest.fixture(scope="module")
def pairs(sides):
    q, c = sides
    both = q.join(c.withColumnRenamed("v", "w"), "pair")
    return both.select("qid", "cid", (F.round(V.cosine(F.col("v"), F.col("w")), 6) + 0.0).alias("sim")).cache()


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


SIZES = (4, 2_048)


@pytest.mark.parametrize("size", SIZES)
def test_entropy_and_diagnostics(sides, pairs, size):
    stats = B.statistics(*sides, 2, "qc", size)
    for axis, by, other in (("q", "qid", "cid"), ("c", "cid", "qid")):
        own = stats.filter(F.col("axis") == axis)
        assert rows(B.entropy(own), "id", "entropy") == rows(J.row_entropy(pairs, by), by, "entropy")
        assert rows(B.diagnostics(own), "id", "best", "z", "margin") == rows(J.axis_diagnostics(pairs, by, other), by, "best", "z", "margin")


@pytest.mark.parametrize("size", SIZES)
def test_csls(sides, pairs, size):
    want = J.csls(pairs, 5)
    assert rows(B.csls(*sides, 5, size), "qid", "cid", "sim", "csls") == rows(want, "qid", "cid", "sim", "csls")
    assert rows(B.mutual_csls(*sides, 5, size), "qid", "cid", "csls") == rows(J.mutual_best(want, "csls"), "qid", "cid", "csls")


@pytest.mark.parametrize("size", SIZES)
def test_accepted(sides, pairs, size):
    want = rows(J.accepted(pairs, "sim", 0.1, 0.5, 0.01, 0.97, z_scores=True), "qid", "cid", "sim")
    assert want and rows(B.accepted(*sides, 0.1, 0.5, 0.01, 0.97, size), "qid", "cid", "sim") == want


def test_no_row_for_each_pair(spark):
    """What leaves the blocks is a row for each vector and block, whatever the number of pairs."""
    e = spark.range(400).select(F.col("id").alias("vec_id"), (F.col("id") % 2).alias("label"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(4)]).alias("embedding"))
    for query in (Q.neighbourhood_entropy, Q.match_diagnostics):
        plan = query(lambda _: e)._jdf.queryExecution().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
    parts = B.meet(*Q.two_groups(lambda _: e), lambda q, c: q.select(["qid"]), "qid long", 50)
    assert parts.count() <= 200 * 4


def test_hash_candidates_share_least_buckets(spark):
    """Pairs meet by all of ``least`` buckets, each once, and nothing is summed up over pairs."""
    planes = [[[math.sin((d + 1) * (b + 2) + 5 * k) for d in range(4)] for b in range(2)] for k in range(4)]
    r = random.Random(2)
    v = {i: [r.gauss(0, 1) for _ in range(4)] for i in range(60)}
    codes = {i: [tuple(sum(x * y for x, y in zip(p, w)) > 0 for p in t) for t in planes] for i, w in v.items()}
    df = spark.createDataFrame([*v.items(), (60, None)], "id long, v array<double>")
    for least in (1, 2, 3):
        hits = {(a, b): sum(x == y for x, y in zip(codes[a], codes[b])) for a in v for b in v if a < b}
        found = J.lsh_candidates(df, planes, least)
        assert sorted(map(tuple, found.collect())) == sorted((*p, n) for p, n in hits.items() if n >= least)
        assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_written_for_few_blocks(spark):
    """up to eight blocks of the other side, where blocks of 1,024 had one for each 1,024; the pairs are all there, each once."""
    rows = spark.range(9_300).select(F.col("id").alias("qid"), F.lit(0).alias("pair"))
    left, right = B.dealt(rows, rows.withColumnRenamed("qid", "cid"), 8 * B.SIZE, 8)
    assert left.count() == right.count() == 9_300 * 8
    e = spark.range(2_600).select(F.col("id").alias("vec_id"), (F.col("id") % 2).alias("label"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(4)]).alias("embedding"))
    got = Q.csls_scores(lambda _: e).agg(F.count("*"), F.min("qid"), F.max("cid"), F.count_distinct("qid"), F.sum(F.col("qid") * 10_000 + F.col("cid")), F.sum(F.col("csls").isNull().cast("int"))).first()
    q, c = range(0, 2_600, 2), range(1, 2_600, 2)
    assert tuple(got) == (1_300 * 1_300, 0, 2_599, 1_300, 1_300 * (10_000 * sum(q) + sum(c)), 0)

import numpy as np
import pytest

from lakeweave.operators import lsh, matching, near_pairs
from lakeweave.operators import neighbour_graph as NG


def sides(spark, m, groups=7):
    rows = [(i, i % groups, x.tolist()) for i, x in enumerate(m)]
    return spark.createDataFrame(rows, "qid long, qgroup long, v array<float>"), spark.createDataFrame(rows, "cid long, cgroup long, v array<float>")


def vectors(n=260, dims=12):
    m = np.random.default_rng(2).normal(size=(n, dims)).astype(np.float32)
    m[50:90] = m[50]  # copies: ties
    m[7], m[8], m[9] = 0, np.inf, np.nan
    m[10] *= 1e18  # longer than single precision holds
    return m


@pytest.mark.parametrize("size", [None, 60])
def test_near_pairs_equal_all_scores(spark, size, monkeypatch):
    monkeypatch.setattr(near_pairs, "COLUMNS", 32)
    m = vectors()
    q, c = sides(spark, m)
    n = np.linalg.norm(m.astype(float), axis=1)
    with np.errstate(all="ignore"):
        u = m / np.where(n < 1e-12, 1, n)[:, None]
        sim = np.round(np.where(np.isfinite(x := u.astype(float) @ u.T.astype(float)), x, 0.0), 5)
    ok = np.arange(260)[:, None] % 7 != np.arange(260)[None] % 7
    for k, threshold in ((4, None), (None, 0.5), (3, 0.3)):
        got = near_pairs.near_pairs(q, c, k, threshold, size=size).collect()
        own = {}
        for r in got:
            assert ok[r.qid, r.cid] and abs(r.score - sim[r.qid, r.cid]) < 2e-5 and (threshold is None or r.score >= threshold)
            own.setdefault(r.qid, []).append(r.score)
        for i in range(260):
            want = np.sort(sim[i][ok[i]])[::-1]
            want = want[want >= threshold + 2e-5] if threshold else want
            want = want[:k]
            assert len(own.get(i, [])) >= len(want) and np.allclose(sorted(own.get(i, []), reverse=True)[: len(want)], want, atol=2e-5)
    ties = sorted((r["rank"], r.cid) for r in near_pairs.near_pairs(q, c, 4, size=size).filter("qid = 51").collect())
    assert [x for _, x in ties] == [50, 52, 53, 54]
    over = {(r.qid, r.cid) for r in near_pairs.near_pairs(q, c, threshold=0.5, size=size).filter("qid < cid").collect()}
    assert over == {(r.qid, r.cid) for r in near_pairs.near_pairs(q, c, threshold=0.5, ordered=True, size=size).collect()}


def test_no_row_is_made_for_a_pair_of_a_bucket(spark):
    """blocks meet as products; a bucket's pairs are never joined or counted as rows."""
    q, c = sides(spark, vectors()[20:])
    planes = np.random.default_rng(0).normal(size=(3, 4, 12)).tolist()
    plan = lsh.multi_probe(q, c, planes, 3)._jdf.queryExecution().toString()
    assert "CoGroupsInArrow" in plan and "hits" not in plan


def test_a_graph_holds_the_nearest_themselves(spark):
    """The lists are exact whatever the blocks."""
    m = np.random.default_rng(6).normal(size=(150, 16))  # without structure
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -9)
    got = {}
    for x in sorted(NG.build(points, 6, 64).collect(), key=lambda x: (x.a, x["rank"])):
        got.setdefault(x.a, []).append(x.b)
    assert got == {i: np.argsort(-sims[i])[:6].tolist() for i in range(150)}


def test_pairs_of_tables_may_lie_in_several_batches(spark):
    r = np.random.default_rng(1)
    tables = {(t, t + 1): r.random((3 + t % 4, 5)) for t in range(0, 60, 2)}
    edges = spark.createDataFrame([(ta, tb, i, j, float(x)) for (ta, tb), m in tables.items() for (i, j), x in np.ndenumerate(m)], "ta long, tb long, a long, b long, sim double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
            got = {}
            for x in matching.align_columns(edges).collect():
                got.setdefault((x.ta, x.tb), []).append((x.a, x.b))
            assert {k: sorted(v) for k, v in got.items()} == {k: sorted(matching.assignment(m)) for k, m in tables.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_answers_without_a_tail_are_not_searched_and_ascii_stays_out_of_python(spark):
    """the function in Python gets nulls for ASCII texts, and the tail of an answer is looked for only where one can end."""
    from pyspark.sql import functions as F

    from lakeweave.functions import serialise as S

    df = spark.createDataFrame([("a ( b" * 50,), ("café * [1] (x)",), (" [a] •\n",), ("x (y)",), ("ẛ̣a",), ("",), (None,)], "x string").select(S.normal_answer(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == [("a ( b" * 50), "cafe", "[a]", "x", "sa", "", None]
    assert "run(CASE WHEN" in df._jdf.queryExecution().analyzed().toString()

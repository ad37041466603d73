import math

import numpy as np
import pytest

from lakeweave.llm import hash_forest as hf

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, key string, rep string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, *[None] * 5) for i, v in rows], SCHEMA)


def vectors(n=600, dims=12, seed=2, copies=300):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, dims)).astype(np.float32).astype(float)
    rows = [(7 * i, m[i].tolist()) for i in range(n)]
    return rows + [(100_000 + i, m[3].tolist()) for i in range(copies)]


def brute(rows, every=50, k=5):
    """All scores, one by one."""
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q in ids[ids % every == 0]:
        x = m[ids == q][0]
        s = (m * x).sum(1) / (np.sqrt((m * m).sum(1)) * np.sqrt((x * x).sum()))
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(df, **more):
    out = {}
    for r in sorted(hf.nearest(df, "id % 50 = 0", **more).collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append((r.id, r.score))
        assert r["rank"] == len(out[r.qid])
    return out


def same(got, want):
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (_, a), (_, b) in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("block,step", [(1024, 128), (32, 8), (16, 64)])
def test_a_budget_of_all_rows_is_exact(spark, block, step):
    rows = vectors()
    same(answers(frame(spark, rows).repartition(5), cost=1e6, block=block, step=step), brute(rows))


def test_recall_with_a_small_budget(spark):
    r = np.random.default_rng(8)
    near = r.normal(size=(200, 24))
    rows = [(i, (near[i % 200] + 0.6 * r.normal(size=24)).astype(np.float32).astype(float).tolist()) for i in range(4000)]
    want = brute(rows)
    got = answers(frame(spark, rows), trees=12, cost=4.0, block=64, step=16)
    assert sum(i in {j for j, _ in want[q]} for q, x in got.items() for i, _ in x) >= 0.9 * 5 * len(want)


def test_the_search_reads_few_rows():
    """The ascent ends at the longest prefix that has the budget, and reads the units of its runs alone."""
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    d = hf.Directory.__new__(hf.Directory)
    first = hf.signed(h)[::10]
    d.first, d.before, d.unit = [first], [np.arange(0, 5001, 10)], [np.arange(500) // 4]
    low, high, units = d.ways(h[[100, 2500]][:, None], 200)
    for k in range(2):
        inside = ((hf.signed(h) >= low[k, 0]) & (hf.signed(h) <= high[k, 0])).sum()
        assert 200 <= inside < 2000 and 200 <= 40 * len(units[k][0]) < 2200


def test_odd_rows(spark):
    rows = vectors(60, copies=0)
    bad = [(50_000, None), (50_001, []), (50_050, [0.0] * 12), (50_100, [None] + [1.0] * 11), (50_150, [math.nan] * 12), (50_200, [math.inf] * 12), (50_250, [1.0] * 5), (None, [1.0] * 12)]
    good = [(60_000, [2.0**126 if i < 6 else -(2.0**126) for i in range(12)]), (60_050, [2.0**-120 * (i + 1) for i in range(12)])]
    same(answers(frame(spark, rows + bad + good)), brute(rows + good))
    same(answers(frame(spark, [*rows, rows[0]])), brute(rows))  # a repeated row counts once
    assert answers(frame(spark, [])) == {} and answers(frame(spark, bad)) == {}
    few = [(0, [1.0, 0.0]), (1, [1.0, 1.0])]
    assert [i for i, _ in answers(frame(spark, few))[0]] == [1]
    assert answers(frame(spark, few[:1])) == {}


def test_scaled_copies_tie_to_the_smaller_id(spark):
    rows = [(i, [float(2 ** (i % 7)), 0.0, float(2 ** (i % 7))]) for i in range(200)]
    same(answers(frame(spark, rows), block=16, step=16), brute(rows))


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in df.collect()]
    want = brute(rows)
    got = {}
    for r in hf.op13_hash_forest(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(i in got[q] for q, x in want.items() for i, _ in x) >= 0.9 * 5 * len(want)

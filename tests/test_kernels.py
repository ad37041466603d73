import itertools
import random

import numpy as np
import pytest

from lakeweave.operators import auction, graph, matching


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (4, 2), (5, 5), (3, 6), (6, 4)])
def test_assignment_equals_brute_force(shape):
    r = np.random.default_rng(sum(shape))
    for _ in range(30):
        m = r.normal(size=shape).round(2)
        pairs = matching.assignment(m)
        assert len(pairs) == min(shape) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        x = m if shape[0] <= shape[1] else m.T
        best = max(sum(x[i, p[i]] for i in range(len(x))) for p in itertools.permutations(range(x.shape[1]), len(x)))
        assert abs(sum(m[p] for p in pairs) - best) < 1e-9


def test_bounds_hold_and_fixture():
    s = matching.scores(np.array([[0.9, 0.8], [0.85, 0.1]]), 0.7)
    assert [round(s[k], 6) for k in ("lower", "exact", "upper")] == [0.9, 1.65, 1.75]
    r = np.random.default_rng(1)
    for _ in range(50):
        s = matching.scores(r.random((4, 5)), 0.3)
        assert s["lower"] <= s["exact"] + 1e-9 <= s["upper"] + 2e-9


def test_greedy_stops_at_the_threshold():
    assert matching.greedy(np.array([[0.5, 0.9], [0.9, 0.2]])) == [(0, 1), (1, 0)]
    assert matching.greedy(np.array([[0.0, -1.0]])) == []


def test_large_pairs_of_tables_go_to_an_auction(spark):
    r = np.random.default_rng(3)
    tables = {(1, 2): np.round(r.random((3, 5)), 2), (5, 6): np.full((3, 3), 0.5), (7, 8): np.array([[0.9, 0.8], [0.8, 0.0]]), (9, 10): np.array([[-1.0]])}
    rows = [(ta, tb, i, j, float(m[i, j])) for (ta, tb), m in tables.items() for i in range(m.shape[0]) for j in range(m.shape[1])]
    edges = spark.createDataFrame(rows, "ta long, tb long, a long, b long, sim double")
    got = matching.align_columns(edges, most=4).collect()
    for (ta, tb), m in tables.items():
        own = [(x.a, x.b) for x in got if (x.ta, x.tb) == (ta, tb)]
        assert len({a for a, _ in own}) == len({b for _, b in own}) == len(own)
        kept = np.where(m < 0, 0.0, m)
        assert abs(sum(m[p] for p in own) - sum(kept[p] for p in matching.assignment(kept))) < 1e-6
    assert auction.auction(edges.limit(0).withColumnRenamed("sim", "gain")).count() == 0


def test_small_auctions_are_dealt_to_tasks(spark, monkeypatch):
    """no rounds of jobs, whose joins and counts all went to the driver; several batches in a task, and pairs that go on in the next one."""
    r = np.random.default_rng(7)
    tables = {(2 * n, 2 * n + 1): np.round(r.random((r.integers(1, 7), r.integers(1, 7))) - 0.2, 2) for n in range(60)}
    rows = [(ta, tb, 100 + i, 200 + j, float(m[i, j])) for (ta, tb), m in tables.items() for i in range(m.shape[0]) for j in range(m.shape[1])]
    edges = spark.createDataFrame([*rows, (0, 1, 100, 200, float("nan"))], "ta long, tb long, a long, b long, gain double")
    monkeypatch.setattr(auction, "BATCH", 40)
    spark.sparkContext.setJobGroup("auction", "")
    got = auction.auction(edges).collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("auction")) <= 10
    spark.sparkContext.setJobGroup("", "")
    by_joins = auction.auction(edges.filter("ta < 8"), local=10).collect()
    for out, pairs in ((got, list(tables)), (by_joins, [p for p in tables if p[0] < 8])):
        for p in pairs:
            own, m = [(x.a - 100, x.b - 200) for x in out if (x.ta, x.tb) == p], np.maximum(tables[p], 0.0)
            assert len({a for a, _ in own}) == len({b for _, b in own}) == len(own)
            assert abs(sum(tables[p][x] for x in own) - sum(m[x] for x in matching.assignment(m))) < 1e-6


def plain_rounds(sim, k, rounds, score, z, margin, entropy):
    """Rounds over one dense matrix."""
    rows, cols, out = list(range(sim.shape[0])), list(range(sim.shape[1])), []
    for turn in range(rounds):
        if not rows or not cols:
            break
        m = sim[np.ix_(rows, cols)]
        mean = lambda x, k: np.sort(x, 1)[:, ::-1][:, : min(k, x.shape[1])].mean(1)
        s = np.round(2 * m - mean(m, k)[:, None] - mean(m.T, k)[None, :], 9)

        def sure(s):
            dev = np.where(s.std(1) < 1e-12, 1.0, s.std(1))
            x = (s - s.max(1, keepdims=True)) / dev[:, None]
            p = np.exp(x) / np.exp(x).sum(1, keepdims=True)
            many = s.shape[1] > 1
            second = np.sort(s, 1)[:, -2] if many else np.full(len(s), -np.inf)
            sharp = -(p * np.log(p)).sum(1) / np.log(s.shape[1]) if many else np.zeros(len(s))
            return s.argmax(1), ((s.max(1) - s.mean(1)) / dev >= z - 5e-7) & ((s.max(1) - second) / dev >= margin - 5e-7) & (sharp <= entropy + 5e-7)

        (best, ok), (other, fine) = sure(s), sure(s.T)
        found = [(i, j) for i, j in enumerate(best) if other[j] == i and ok[i] and fine[j] and s[i, j] >= score]
        if not found:
            break
        out += [(rows[i], cols[j], turn) for i, j in found]
        rows = [r for i, r in enumerate(rows) if i not in {x for x, _ in found}]
        cols = [c for j, c in enumerate(cols) if j not in {y for _, y in found}]
    return out


@pytest.mark.parametrize("tests", [(-9.0, 0.0, 0.0, 1.0), (-0.2, 1.1, 0.15, 0.97)])
def test_reciprocal_rounds_equal_the_plain_version(spark, tests):
    r = np.random.default_rng(5)
    tables = {(1, 2): r.random((7, 9)), (3, 4): r.random((6, 1)), (5, 6): np.round(r.random((5, 5)), 1), (7, 8): np.ones((3, 2))}
    rows = [(ta, tb, i, j, float(m[i, j])) for (ta, tb), m in tables.items() for i in range(m.shape[0]) for j in range(m.shape[1])]
    edges = spark.createDataFrame(rows, "ta long, tb long, a long, b long, sim double")
    score, z, margin, entropy = tests
    got = matching.reciprocal_join(edges, 3, 6, score, z, margin, entropy, z_scores=True).collect()
    want = sorted((ta, tb, *p) for (ta, tb), m in tables.items() for p in plain_rounds(m, 3, 6, *tests))
    assert sorted((x.ta, x.tb, x.a, x.b, x.turn) for x in got) == want and want
    assert matching.reciprocal_join(edges.limit(0)).count() == 0


def test_capped_walk():
    of = graph.capped_walk([(1, 2), (2, 3), (3, 4)], 2)
    sizes = [list(of.values()).count(c) for c in set(of.values())]
    assert max(sizes) <= 2 and set(of) == {1, 2, 3, 4}


def test_components_on_a_path_and_random_graphs(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    up = {n: n for e in edges for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {x.node: x.comp for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in up}
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame(edges, "a long, b long"), max_rounds=1)
    capped = graph.capped_components(spark.createDataFrame([(a, b, 0.5 + i / 1000) for i, (a, b) in enumerate(edges)], "a long, b long, sim double"), 7)
    assert capped.groupBy("cluster").count().agg({"count": "max"}).first()[0] <= 7
    assert {x.node for x in capped.collect()} == set(up)


def test_anchors_equal_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(f"k{i:02}", float(a), float(b)) for i, (a, b) in enumerate(np.exp(r.normal(size=(40, 2))).round(3))]
    x = np.array([[np.log1p(a), b] for _, a, b in rows])
    x = (x - x.mean(0)) / x.std(0)
    want = [int(np.argmin((x**2).sum(1)))]
    while len(want) < 6:
        near = np.min([((x - x[i]) ** 2).sum(1) for i in want], 0)
        near[want] = -1
        want.append(int(np.argmax(near)))
    p = spark.createDataFrame(rows, "k string, a double, b double")
    assert graph.farthest_points(p, "k", ["a", "b"], 6, ["a"]) == [rows[i][0] for i in want]
    assert len(graph.farthest_points(p, "k", ["a"], 99)) == 40 and graph.farthest_points(p.limit(0), "k", ["a"], 2) == []


def test_upper_bound_waits_for_nodes_with_edges_only():
    gain = np.array([[0.9, 0.8, 0.1], [0.2, 0.75, 0.1], [0.1, 0.1, 0.1]])
    assert matching.upper_bound(gain, 0.7) == pytest.approx(0.9 + 0.8)  # both columns with edges are met
    assert matching.upper_bound(np.array([[0.9, 0.8], [0.3, 0.2]]), 0.7) == pytest.approx(0.9)  # the one row with edges is met


def test_pairs_are_classified(spark):
    sizes = spark.createDataFrame([(0, 1, 4, 2), (2, 3, 4, 9), (4, 5, 4, 4)], "ta long, tb long, na long, nb long")
    aligned = [(0, 1, 1, 9, 0.9), (0, 1, 2, 8, 0.7), (0, 1, 3, 7, 0.8), (2, 3, 5, 6, 0.95), (2, 3, 6, 5, 0.1)]
    got = {x.ta: x for x in matching.classify_pairs(spark.createDataFrame(aligned, "ta long, tb long, a long, b long, sim double"), sizes, floor=0.5).collect()}
    assert got[0].relation == "union" and got[0].confidence == 0.75 and got[0].key_a is None  # 3 of 4 columns, mean 0.8
    assert got[2].relation == "join" and got[2].confidence == 0.95 and (got[2].key_a, got[2].key_b) == (5, 6)
    assert got[4].relation == "none" and got[4].confidence == 1.0
    scored = {x.ta: x.normalised for x in matching.match_tables(spark.createDataFrame(aligned, "ta long, tb long, a long, b long, sim double"), sizes, 0.7).collect()}
    assert scored == {0: pytest.approx(1.2), 2: pytest.approx(0.2375), 4: 0.0}  # an edge of the threshold itself counts


def test_quantiles_and_places_equal_numpy(spark):
    from lakeweave.operators import ranks

    r = np.random.default_rng(5)
    rows = [("ab"[i % 3 == 0], float(v)) for i, v in enumerate(r.integers(0, 40, 500))] + [("a", None), ("c", 7.0)]
    got = ranks.counted(spark.createDataFrame(rows, "g string, x double").repartition(7), "x", ["g"])
    for x in got.collect():
        own = [v for g, v in rows if g == x.g and v is not None]
        assert (x.n, x.before) == (own.count(x.x), sum(v < x.x for v in own))
    for x in ranks.quantiles(got, "x", {"low": 0.1, "mid": 0.5, "high": 0.9}, ["g"]).collect():
        own = [v for g, v in rows if g == x.g and v is not None]
        assert (x.low, x.mid, x.high) == pytest.approx(tuple(np.quantile(own, [0.1, 0.5, 0.9])))


def test_all_tables_are_matched(spark):
    from lakeweave.plans import kernel_queries

    r = np.random.default_rng(9)
    v = [None if i == 170 else np.zeros(3) if i == 171 else r.normal(size=3) for i in range(250)]
    rows = spark.createDataFrame([(i, None if x is None else x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    unit = [None if x is None else (y := x.astype(np.float32).astype(float)) / (np.linalg.norm(y) or 1) for x in v]
    want = {(a // 8, b // 8, a, b): unit[a] @ unit[b] for a in range(250) for b in range(250) if a // 8 % 2 == 0 and b // 8 == a // 8 + 1 and unit[a] is not None and unit[b] is not None}
    got = {tuple(x[:4]): x.sim for x in kernel_queries.edges(lambda _: rows).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
    best = {(x.ta, x.tb): x.exact for x in kernel_queries.assignment_score(lambda _: rows).collect()}
    assert best.keys() == {k[:2] for k in want}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_pruned_top_tables_equal_brute_force(spark, k):
    r = np.random.default_rng(2)
    rows, want = [], {}
    for ta in range(4):
        found = []
        for tb in range(10, 22):
            m = r.random((3, 1 + tb % 4)).round(3)
            rows += [(ta, tb, i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
            kept = np.where(m > 0.6, m, 0.0)
            found.append((-round(float(sum(kept[p] for p in matching.assignment(kept))), 6), tb))
        want |= {(ta, tb): (-s, i + 1) for i, (s, tb) in enumerate(sorted(found)[:k])}
    edges = spark.createDataFrame(rows, "ta long, tb long, a long, b long, sim double")
    got = matching.top_tables(edges, edges.select("ta", "tb").distinct(), 0.6, k).collect()
    assert {(x.ta, x.tb): (x.score, x.rank) for x in got} == want


def test_probes_learn_what_is_there(spark):
    from pyspark.sql import functions as F

    from lakeweave.operators import models

    r = np.random.default_rng(6)
    x = r.normal(size=(600, 3))
    rows = [(i, v.tolist(), int(v[0] * v[1] > 0), float(3 * v[0])) for i, v in enumerate(x)]  # no line parts the classes
    df = spark.createDataFrame(rows, "id long, v array<double>, y int, z double")
    fold = F.col("id") % 5
    assert models.forest_probe(df, "v", "y", fold, trees=15).first().accuracy > 0.85
    assert models.mlp_probe(df, "v", "y", fold, 3, 2, sweep=(12,)).first().accuracy > 0.85
    assert models.logistic_probe(df, "v", "y", fold).first().accuracy < 0.7
    assert models.forest_probe(df, "v", "z", fold, classes=False, trees=15).first().rmse < 1.2
    assert models.ridge_probe(df, "v", "z", fold).first().rmse < 0.1


def test_random_tokens_are_a_sample_in_order(spark):
    from lakeweave.functions import serialise

    text = " ".join(f"w{i:03}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, "a b"), (3, None)], "k int, t string")
    got = {x.k: x.tokens for x in serialise.token_sample(docs, "k", "t", "random", 20).collect()}
    assert len(got[1]) == 20 and got[1] == sorted(set(got[1])) and got[2] == ["a", "b"] and not got[3]

"""Clusters of a similarity graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = 1 << 16  # edges that a task gathers before it makes stars of them
MOST = 500_000  # so many edges are joined by one task; more are rounds of joins


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of the n nodes that each is joined with by edges (i, j), and positions of edges, fewer than n, that join them.

    In each turn every root that has a smaller neighbour is hung below the smallest; at least half of those that have any go."""
    up, at, kept = np.arange(n), np.arange(len(i)), []
    while True:
        i, j = up[i], up[j]
        at, i, j = (x[i != j] for x in (at, i, j))
        if not len(at):
            return up, np.sort(np.concatenate([np.empty(0, np.int64), *kept]))
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, np.maximum(i, j), np.minimum(i, j) * len(at) + np.arange(len(at)))
        roots = np.flatnonzero(best < np.iinfo(np.int64).max)
        up[roots], edge = np.divmod(best[roots], len(at))
        kept.append(at[edge])
        while (up[up] != up).any():
            up = up[up]


def spanning(i: np.ndarray, j: np.ndarray, n: int, m: int) -> np.ndarray:
    """Positions of pairs of one of n and one of m things that join all that the pairs join: fewer than n + m."""
    return _joined(n + m, i, j + n)[1]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b), behind the smallest that it is joined with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes[_joined(len(nodes), at[: len(a)], at[len(a) :])[0]], nodes


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): in each task's edges each node b and the smallest, a, of its component. A task holds its nodes, not its edges."""
    edges = edges.select("a", "b").filter("a is not null and b is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, rows, schema = None, [], 0, None
        for x in batches:
            schema, rows = x.schema, rows + x.num_rows
            more.append([c.to_numpy(zero_copy_only=False) for c in x.columns])
            if rows >= HELD + (0 if held is None else len(held[0])):
                held, more, rows = _stars(*map(np.concatenate, zip(*([] if held is None else [held]), *more, strict=True))), [], 0
        if more:
            held = _stars(*map(np.concatenate, zip(*([] if held is None else [held]), *more, strict=True)))
        if held is not None:
            yield from pa.table([pa.array(c, t) for c, t in zip(held, schema.types, strict=True)], schema=schema).to_batches(max_chunksize=HELD)

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, comp): the smallest node that can be reached, by min labels with jumps; each round's table is checkpointed.

    Tasks first make stars of their edges, which leaves a row for each task and node. Up to MOST of them are joined by one more task; what is
    above it goes through rounds until nothing changes. With ``max_rounds`` there are only rounds, and an error says that they did not suffice.
    """
    edges = stars(edges).checkpoint()
    if max_rounds is None:
        n = edges.count()
        while n > MOST:
            edges = stars(edges.repartition(-(-n // MOST), "a")).checkpoint()
            before, n = n, edges.count()
            if 2 * n > before:
                break
        if n <= MOST:
            return stars(edges.repartition(1)).select(F.col("b").alias("node"), F.col("a").alias("comp"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")).checkpoint()
    rounds = 0
    while True:
        if rounds == max_rounds:
            raise RuntimeError(f"labels still change after {max_rounds} rounds")
        rounds += 1
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        now = step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("comp")).checkpoint()
        labels = now.select("node", "comp")
        if not now.filter("old <> comp").limit(1).count():
            return labels


def capped_walk(edges: list[tuple[int, int]], cap: int) -> dict[int, int]:
    """Breadth-first clusters of at most ``cap`` nodes. Seeds come in the order in which edges (best first) name them."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    of: dict[int, int] = {}
    for seed in near:
        if seed in of:
            continue
        of[seed], queue, size = seed, [seed], 1
        for node in queue:
            for other in near[node]:
                if size >= cap:
                    break
                if other not in of:
                    of[other] = seed
                    queue.append(other)
                    size += 1
    return of


def capped_components(edges: DataFrame, cap: int) -> DataFrame:
    """(node, cluster) with at most ``cap`` nodes a cluster. Order only matters within a component, so that each plain
    component is one group and groups run in parallel; edges are walked by sim descending, then a, b."""
    edges = edges.select("a", "b", "sim").checkpoint()
    own = edges.join(components(edges), edges["a"] == F.col("node")).select("comp", "a", "b", "sim")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sim", "a", "b"], ascending=[False, True, True])
        of = capped_walk(list(zip(pdf.a.tolist(), pdf.b.tolist(), strict=True)), cap)
        return pd.DataFrame({"node": list(of), "cluster": list(of.values())})

    return own.groupBy("comp").applyInPandas(run, "node long, cluster long")


def tune_cap(edges: DataFrame, target: float, high: int = 5000, width: int = 10) -> int:
    """The cap, by bisection, at which clusters have ``target`` nodes on average."""
    low = 0
    while high - low > width:
        mid = (low + high) // 2
        nodes, clusters = capped_components(edges, max(1, mid)).agg(F.count("*"), F.countDistinct("cluster")).first()
        low, high = (mid, high) if clusters and nodes / clusters < target else (low, mid)
    return (low + high) // 2


def farthest_points(points: DataFrame, key: str, features: list[str], n: int, counts: list[str] = ()) -> list:
    """Keys of ``n`` anchors: the point nearest the mean first, then the one that is farthest from all anchors so far.

    Features are z-scores (population deviation), those of ``counts`` after log1p. Ties go to the least key. One aggregate an
    anchor; each point's distance to the nearest anchor is a sum over the few features.
    """
    x = points.select(key, *[(F.log1p(c) if c in counts else F.col(c).cast("double")).alias(c) for c in features])
    stats = x.agg(*[f(c).alias(f"{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = x.select(key, *[((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)).alias(c) for c in features])
    away = lambda p: F.round(sum(((F.col(f) - F.lit(p[f])) ** 2 for f in features), F.lit(0.0)), 9)
    chosen = [z.orderBy(away(dict.fromkeys(features, 0.0)), key).first()]
    while chosen[-1] is not None and len(chosen) < n:
        near = F.least(*[away(c) for c in chosen], F.lit(float("inf")))
        chosen.append(z.filter(~F.col(key).isin([c[key] for c in chosen])).orderBy(near.desc(), key).first())
    return [c[key] for c in chosen if c is not None]

"""Optimal one-to-one assignments by auction. Pairs of tables of up to LOCAL edges are dealt to tasks, each of which holds the auctions of many
pairs at once; larger ones are rounds of joins, so that no pair of tables has to fit a task.

Edges that gain nothing are left out, and a node may stay alone. To let prices fall back between scaling phases, the graph is doubled: a
mirror image with sides exchanged, and an edge of no gain between each node and its image. Every node of the double has a partner in some
best solution, which holds a best matching of each half. Persons without an object bid for their best one, up to its
advantage over the second best; each object goes to its best bid; prices only rise within a phase, and each phase begins with the prices of the
one before and smaller least steps. At the end the sum is within ``gap`` of the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.sources.writers import checkpoint_dir

PAIR = ["ta", "tb"]
FALL = 6.0  # from phase to phase the least step is divided by it
LOCAL, BATCH = 500_000, 1 << 16  # most edges of a pair of tables that is dealt to a task; edges whose auctions run at once there


def doubled(edges: DataFrame) -> DataFrame:
    """(ta, tb, p, o, w): persons and objects of both halves; node x of the first half is 2x, of the mirror image 2x + 1."""
    a, b = 2 * F.col("a"), 2 * F.col("b")
    both = F.explode(F.array(F.struct(a.alias("p"), b.alias("o")), F.struct((b + 1).alias("p"), (a + 1).alias("o"))))
    real = edges.select(*PAIR, both.alias("x"), F.col("gain").alias("w")).select(*PAIR, "x.p", "x.o", "w")
    rows, cols = edges.select(*PAIR, a.alias("p")).distinct(), edges.select(*PAIR, b.alias("o")).distinct()
    alone = rows.withColumn("o", F.col("p") + 1).unionByName(cols.withColumn("p", F.col("o") + 1))
    return real.unionByName(alone.withColumn("w", F.lit(0.0)))


def steps(top: float, nodes: int, gap: float) -> Iterator[float]:
    """The least steps of the phases, of which the last bounds what the sum may lack."""
    last = gap / max(nodes, 1)
    step = max(top / 4, last)
    while step > last:
        yield step
        step = max(step / FALL, last)
    yield last


def matched(pair: np.ndarray, a: np.ndarray, b: np.ndarray, gain: np.ndarray, gap: float = 1e-6) -> np.ndarray:
    """Which edges are in a best matching of their pair; the pairs' graphs, doubled as above, lie side by side in one."""
    number = lambda x: np.unique(np.stack([pair, x]), axis=1, return_inverse=True)[1].ravel()
    r, c = number(a), number(b)
    n, m = r.max() + 1, c.max() + 1
    rows, cols = np.arange(n), np.arange(m)
    p, o = np.r_[r, n + c, rows, n + cols], np.r_[c, m + r, m + rows, cols]
    w = np.r_[gain, gain, np.zeros(n + m)]
    order = np.lexsort((o, p))
    p, o, w = p[order], o[order], w[order]
    begin = np.searchsorted(p, np.arange(n + m + 1))
    price, most = np.zeros(n + m), np.bincount(np.unique(np.stack([np.r_[pair, pair], np.r_[r, n + c]]), axis=1)[0]).max()
    for step in steps(gain.max(), int(most), gap):
        holder, free = np.full(n + m, -1), np.arange(n + m)
        while len(free):
            size = begin[free + 1] - begin[free]
            at = np.cumsum(size) - size
            e = np.repeat(begin[free] - at, size) + np.arange(size.sum())
            v = w[e] - price[o[e]]
            first = np.maximum.reduceat(v, at)
            own = np.flatnonzero(v == np.repeat(first, size))
            best = own[np.searchsorted(own, at)]  # of equal ones the least object
            v[best] = -np.inf
            second = np.maximum.reduceat(v, at)
            bid, to = price[o[e[best]]] + first - second + step, o[e[best]]
            rank = np.lexsort((free, -bid, to))
            won = rank[np.r_[True, to[rank][1:] != to[rank][:-1]]]
            lost = np.ones(len(free), bool)
            lost[won] = False
            put_out = holder[to[won]]
            holder[to[won]], price[to[won]] = free[won], bid[won]
            free = np.r_[free[lost], put_out[put_out >= 0]]
    return holder[c] == r


def in_tasks(edges: DataFrame, gap: float) -> DataFrame:
    """The auctions of pairs of tables that are small: a task takes pairs until they have BATCH edges, and holds their auctions at once."""
    kinds = edges.select(*PAIR, "a", "b").schema

    def settled(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ta, tb, a, b, gain = (t[c].to_numpy() for c in (*PAIR, "a", "b", "gain"))
        pair = np.cumsum(np.r_[False, (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])])
        yield from t.select([*PAIR, "a", "b"]).filter(pa.array(matched(pair, a, b, gain, gap))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for x in batches:
            waiting, n = [*waiting, x], n + x.num_rows
            if n >= BATCH:
                t = pa.Table.from_batches(waiting)
                ta, tb = t["ta"].to_numpy(), t["tb"].to_numpy()
                whole = int(np.argmax((ta == ta[-1]) & (tb == tb[-1])))  # the last pair may go on
                if whole:
                    yield from settled(t.slice(0, whole))
                waiting = t.slice(whole).to_batches()
                n = n - whole if whole else 0  # a pair larger than that waits for as many edges again
        if any(x.num_rows for x in waiting):
            yield from settled(pa.Table.from_batches(waiting))

    return edges.select(*PAIR, "a", "b", "gain").repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(run, kinds)


def auction(edges: DataFrame, gap: float = 1e-6, local: int = LOCAL) -> DataFrame:
    """(ta, tb, a, b) of a matching over (ta, tb, a, b, gain > 0) with the largest sum of gains for each pair of tables, within ``gap``.

    Pairs of more than ``local`` edges go by joins.
    """
    gains = edges.filter("gain > 0 and not isnan(gain)").groupBy(*PAIR, "a", "b").agg(F.max("gain").cast("double").alias("gain"))
    large = gains.groupBy(*PAIR).agg(F.count("*").alias("n")).filter(F.col("n") > local).select(*PAIR)
    if not large.limit(1).count():
        return in_tasks(gains, gap)
    small = in_tasks(gains.join(large, PAIR, "left_anti"), gap)
    return small.unionByName(by_joins(gains.join(large, PAIR, "left_semi"), gap))


def by_joins(gains: DataFrame, gap: float) -> DataFrame:
    """The auctions as rounds of joins. None is a broadcast, as each round would send it to the driver."""
    checkpoint_dir(gains.sparkSession)
    graph = doubled(gains).checkpoint()
    top, nodes = graph.agg(F.max("w")).first()[0], graph.groupBy(*PAIR).agg(F.countDistinct("p").alias("n")).agg(F.max("n")).first()[0]
    prices = graph.select(*PAIR, "o").distinct().withColumn("price", F.lit(0.0)).checkpoint()
    people = graph.select(*PAIR, "p").distinct()
    held = prices.withColumn("p", F.lit(None).cast("long"))
    for step in steps(top or 0.0, nodes, gap) if nodes else ():
        held = held.withColumn("p", F.lit(None).cast("long"))
        while True:
            free = people.join(held.filter("p is not null").select(*PAIR, "p").hint("merge"), [*PAIR, "p"], "left_anti")
            offers = graph.join(free.hint("merge"), [*PAIR, "p"]).join(held.select(*PAIR, "o", "price").hint("merge"), [*PAIR, "o"]).withColumn("v", F.col("w") - F.col("price"))
            two = offers.withColumn("r", F.row_number().over(Window.partitionBy(*PAIR, "p").orderBy(F.desc("v"), "o"))).filter("r <= 2")
            first = lambda c: F.max(F.when(F.col("r") == 1, F.col(c)))
            bids = two.groupBy(*PAIR, "p").agg(first("o").alias("o"), (first("price") + first("v") - F.min("v") + step).alias("bid"))
            won = bids.groupBy(*PAIR, "o").agg(F.max(F.struct("bid", (-F.col("p")).alias("p"))).alias("x"))
            now = held.join(won.hint("merge"), [*PAIR, "o"], "left")
            held = now.select(*PAIR, "o", F.coalesce("x.bid", "price").alias("price"), F.coalesce(-F.col("x.p"), F.col("p")).alias("p")).checkpoint()
            if not held.filter("p is null").limit(1).count():
                break
    found = held.filter("p % 2 = 0 and o % 2 = 0")
    return found.select(*PAIR, (F.col("p") / 2).cast("long").alias("a"), (F.col("o") / 2).cast("long").alias("b"))

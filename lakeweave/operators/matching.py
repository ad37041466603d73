"""Matchings between the columns, or rows, of two tables. A pair of tables of few columns is one small group: the kernels run on one
similarity matrix at a time, over edges sorted by pairs of tables. Optimal pairs of large tables come from an auction, and rounds
of reciprocal matches are joins at any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.sources.writers import checkpoint_dir

from . import auction
from .vector_join import top_k


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one matching with the largest sum, as many as the shorter side has.

    Shortest augmenting paths with potentials: one row enters at a time, in O(rows * columns) after each step.
    """
    if not gain.size:
        return []
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    u, v, of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        least, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, reach, last = row, 0.0, -1
        while True:
            step = reach + cost[i] - u[i] - v
            better = ~done & (step < least)
            least[better], back[better] = step[better], last
            j = int(np.argmin(np.where(done, np.inf, least)))
            reach, done[j] = least[j], True
            last = j
            if of[j] < 0:
                break
            i = of[j]
        u[row] += reach
        for j in np.flatnonzero(done):
            if j != last:
                u[of[j]] += reach - least[j]
                v[j] -= reach - least[j]
        while last >= 0:
            before = back[last]
            of[last] = row if before < 0 else of[before]
            last = before
    pairs = [(int(of[j]), j) for j in range(m) if of[j] >= 0]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def greedy(gain: np.ndarray, least: float = 0.0) -> list[tuple[int, int]]:
    """Best first, each row and column once, while the gain is over ``least``; ties by row, then column."""
    out, rows, cols = [], set(), set()
    for at in np.lexsort((np.tile(np.arange(gain.shape[1]), gain.shape[0]), np.repeat(np.arange(gain.shape[0]), gain.shape[1]), -gain.ravel())):
        i, j = divmod(int(at), gain.shape[1])
        if gain[i, j] <= least:
            break
        if i not in rows and j not in cols:
            out.append((i, j))
            rows.add(i)
            cols.add(j)
    return out


def upper_bound(gain: np.ndarray, threshold: float) -> float:
    """All edges over the threshold, best first, until one side has no free node of those that have an edge at all."""
    over = gain > threshold
    total, rows, cols, wait_rows, wait_cols = 0.0, set(), set(), int(over.any(1).sum()), int(over.any(0).sum())
    for at in np.argsort(-gain.ravel(), kind="stable"):
        i, j = divmod(int(at), gain.shape[1])
        if not over[i, j] or len(rows) == wait_rows or len(cols) == wait_cols:
            break
        total += gain[i, j]
        rows.add(i)
        cols.add(j)
    return total


def scores(gain: np.ndarray, threshold: float) -> dict[str, float]:
    """Lower bound (greedy), exact and upper bound of the matching over edges with gain > threshold."""
    kept = np.where(gain > threshold, gain, 0.0)
    return {"lower": sum(kept[p] for p in greedy(kept)), "exact": sum(kept[p] for p in assignment(kept)), "upper": upper_bound(gain, threshold)}


def per_pair(edges: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """(ta, tb, and ``schema``): the rows that ``kernel`` (matrix of similarities, ids of its rows, ids of its columns) gives for each pair of tables.

    Edges (ta, tb, a, b, sim) come sorted by pairs, many pairs to a batch; what a batch has of its last pair waits for the next one.
    """
    names = ["ta", "tb", *(x.split()[0] for x in schema.split(", "))]
    kinds = [pa.int64(), pa.int64(), *({"long": pa.int64(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", "))]

    def rows(t: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        ta, tb, a, b, sim = (t[c].to_numpy() for c in ("ta", "tb", "a", "b", "sim"))
        out = []
        for x, y in zip(ends[:-1], ends[1:], strict=True):
            (of_a, i), (of_b, j) = np.unique(a[x:y], return_inverse=True), np.unique(b[x:y], return_inverse=True)
            m = np.zeros((len(of_a), len(of_b)))
            m[i, j] = np.where(np.isnan(sim[x:y]), 0.0, sim[x:y])
            out += [(ta[x], tb[x], *r) for r in kernel(m, of_a, of_b)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ta, tb = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero((ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])) + 1
            if waiting and (waiting[-1].column(0)[-1].as_py(), waiting[-1].column(1)[-1].as_py()) != (ta[0], tb[0]):
                cut = np.r_[0, cut]
            if not len(cut):
                waiting.append(b)
                continue
            before = sum(x.num_rows for x in waiting)
            ends = np.unique(np.r_[0, cut + before])
            yield rows(pa.Table.from_batches([*waiting, b]), ends)
            waiting = [b.slice(cut[-1])]
        if waiting:
            yield rows(pa.Table.from_batches(waiting), np.array([0, sum(x.num_rows for x in waiting)]))

    own = edges.select(F.col("ta").cast("long").alias("ta"), F.col("tb").cast("long").alias("tb"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "sim")
    return own.repartition("ta", "tb").sortWithinPartitions("ta", "tb").mapInArrow(run, f"ta long, tb long, {schema}")


def match_tables(edges: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """edges (ta, tb, a, b, sim) of columns a of table ta and b of tb: bounds and score of each pair of tables.

    ``sizes`` (ta, tb, na, nb) has the tables' numbers of columns, with or without edges. Bounds and ``exact`` count edges of
    sim > threshold; ``normalised`` is the matching over edges of sim >= threshold by the columns of the smaller table.
    """

    def run(m: np.ndarray, *_) -> list[tuple]:
        whole = np.where(m < threshold, 0.0, m)
        s = scores(m, threshold) | {"matched": sum(whole[p] for p in assignment(whole))}
        return [tuple(round(float(s[k]), 6) for k in ("lower", "exact", "upper", "matched"))]

    out = per_pair(edges, run, "lower double, exact double, upper double, matched double")
    norm = F.round(F.coalesce(F.try_divide(F.col("matched"), F.least("na", "nb")), F.lit(0.0)), 6)
    return sizes.join(out, ["ta", "tb"], "left").fillna(0.0).select("ta", "tb", "lower", "exact", "upper", norm.alias("normalised"))


def mixed_score(score: Column, na: Column, nb: Column, topic: Column) -> Column:
    """The matching by the columns of the smaller table, plus the cosine of the tables' topics."""
    return score / F.least(na, nb) + topic


def top_tables(edges: DataFrame, sizes: DataFrame, threshold: float, k: int) -> DataFrame:
    """(ta, tb, score, rank): the k tables with the largest matching for each query table ta; ties go to the least tb.

    Bounds come first: a pair whose upper bound is under the k-th best lower bound of its query is never matched exactly.
    """

    def bounds_of(m: np.ndarray, *_) -> list[tuple]:
        return [(round(float(sum(m[p] for p in greedy(np.where(m > threshold, m, 0.0)))), 6), round(float(upper_bound(m, threshold)), 6))]

    def exact_of(m: np.ndarray, *_) -> list[tuple]:
        kept = np.where(m > threshold, m, 0.0)
        return [(round(float(sum(kept[p] for p in assignment(kept))), 6),)]

    bounds = sizes.select("ta", "tb").join(per_pair(edges, bounds_of, "lower double, upper double"), ["ta", "tb"], "left").fillna(0.0)
    least = top_k(bounds, ["ta"], k, F.col("lower").desc(), F.col("tb")).groupBy("ta").agg(F.when(F.count("*") >= k, F.min("lower")).alias("least"))
    open_ = bounds.join(least, "ta").filter(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("ta", "tb")
    exact = per_pair(edges.join(open_, ["ta", "tb"], "left_semi"), exact_of, "score double")
    return top_k(open_.join(exact, ["ta", "tb"], "left").fillna(0.0), ["ta"], k, F.col("score").desc(), F.col("tb"))


def align_columns(edges: DataFrame, how: str = "optimal", threshold: float = 0.0, most: int = 4_000_000) -> DataFrame:
    """One-to-one pairs of columns: optimal (no threshold before, sim > threshold after) or greedy.

    A pair of tables of up to ``most`` edges is one dense matrix in one task; optimal pairs of larger ones come from an auction.
    """

    def run(m: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple]:
        pairs = assignment(np.where(m < threshold, 0.0, m)) if how == "optimal" else greedy(m, threshold)
        return [(rows[i], cols[j], m[i, j]) for i, j in pairs if m[i, j] > threshold]

    dense = lambda e: per_pair(e, run, "a long, b long, sim double")
    if how != "optimal":
        return dense(edges)
    large = edges.groupBy("ta", "tb").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("ta", "tb")
    if not large.limit(1).count():
        return dense(edges)
    own = edges.join(large, ["ta", "tb"], "left_semi").filter((F.col("sim") >= threshold) & (F.col("sim") > 0))
    found = own.join(auction.auction(own.withColumnRenamed("sim", "gain")), ["ta", "tb", "a", "b"]).filter(F.col("sim") > threshold)
    return dense(edges.join(large, ["ta", "tb"], "left_anti")).unionByName(found.select("ta", "tb", "a", "b", "sim"))


def classify_pairs(aligned: DataFrame, sizes: DataFrame, union_ratio: float = 0.6, union_mean: float = 0.6, join_ratio: float = 0.5, key_sim: float = 0.7, floor: float = 0.0) -> DataFrame:
    """union, join or none for each pair of tables (ta the query, of na columns), with a confidence: rules on the aligned pairs.

    Pairs of sim >= ``floor`` count as matched: their share of the query's columns, and their mean. The best of all pairs,
    matched or not, is the key of a join (of equal ones that of the least column).
    """
    over = F.col("sim") >= floor
    best = F.min_by(F.struct("a", "b"), F.struct(-F.col("sim"), F.col("a"), F.col("b")))
    a = aligned.groupBy("ta", "tb").agg(F.count_if(over).alias("n"), F.avg(F.when(over, F.col("sim"))).alias("mean"), F.max("sim").alias("best"), best.alias("key"))
    a = a.select("ta", "tb", "n", "mean", "best", F.col("key.a").alias("key_a"), F.col("key.b").alias("key_b"))
    ratio = F.coalesce(F.try_divide(F.col("n"), F.col("na")), F.lit(0.0))
    x = sizes.join(a, ["ta", "tb"], "left").fillna(0, ["n", "mean", "best"]).withColumn("ratio", ratio)
    union = (F.col("ratio") >= union_ratio) & (F.col("mean") >= union_mean)
    join = (F.col("ratio") <= join_ratio) & (F.col("best") >= key_sim) & F.col("n").between(1, 3)
    kind = F.when(union, "union").when(join, "join").otherwise("none")
    conf = F.when(union, F.least("ratio", "mean")).when(join, F.col("best")).otherwise(1 - F.col("best"))
    return x.select("ta", "tb", kind.alias("relation"), F.round(conf, 9).alias("confidence"), F.when(kind == "join", F.col("key_a")).alias("key_a"), F.when(kind == "join", F.col("key_b")).alias("key_b"))


PAIR = ["ta", "tb"]


def _scored(edges: DataFrame, k: int) -> DataFrame:
    """Edges with ``score``: by CSLS, twice the similarity less the means of both ends' k best; without ``k`` the similarity."""
    if not k:
        return edges.withColumn("score", F.col("sim"))
    mean = lambda by, other: top_k(edges, [*PAIR, by], k, F.col("sim").desc(), F.col(other)).groupBy(*PAIR, by).agg(F.avg("sim").alias(f"m_{by}"))
    both = edges.join(mean("a", "b"), [*PAIR, "a"]).join(mean("b", "a"), [*PAIR, "b"])
    return both.withColumn("score", F.round(2 * F.col("sim") - F.col("m_a") - F.col("m_b"), 9)).drop("m_a", "m_b")


def _sure(scored: DataFrame, by: str, other: str, least_z: float, least_margin: float, most_entropy: float, z_scores: bool) -> DataFrame:
    """(ta, tb, a, b): each row's best partner, where its z-score and margin (over the deviation) are large and the entropy of the row is small."""
    first = F.max(F.struct(F.col("score").alias("s"), (-F.col(other)).alias("i")))  # ties: the least id
    d = scored.groupBy(*PAIR, by).agg(first.alias("top"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev"), F.count("*").alias("n"))
    d = d.select(*PAIR, by, F.col("top.s").alias("s1"), (-F.col("top.i")).alias("best"), "mean", "n", F.when(F.col("dev") < 1e-12, F.lit(1.0)).otherwise(F.col("dev")).alias("dev"))
    x = (F.col("score") - F.col("s1")) / (F.col("dev") if z_scores else F.lit(1.0))
    e = scored.join(d, [*PAIR, by]).withColumn("_x", x).withColumn("_e", F.exp("_x"))
    e = e.groupBy(*PAIR, by, "best", "s1", "mean", "dev", "n").agg(F.max(F.when(F.col(other) != F.col("best"), F.col("score"))).alias("s2"), F.sum("_e").alias("z"), F.sum(F.col("_e") * F.col("_x")).alias("y"))
    over = lambda c: F.round(c / F.col("dev"), 6)
    margin = F.when(F.col("n") > 1, over(F.col("s1") - F.col("s2"))).otherwise(F.lit(float("inf")))
    entropy = F.when(F.col("n") > 1, F.round((F.log("z") - F.col("y") / F.col("z")) / F.log("n"), 6)).otherwise(F.lit(0.0))
    sure = (over(F.col("s1") - F.col("mean")) >= least_z) & (margin >= least_margin) & (entropy <= most_entropy)
    return e.filter(sure).select(*PAIR, by, F.col("best").alias(other))


def reciprocal_join(edges: DataFrame, k: int = 5, rounds: int = 10, least_score: float | None = None, least_z: float = 0.0, least_margin: float = 0.0, most_entropy: float = 1.0, z_scores: bool = False) -> DataFrame:
    """Rows a of table ta with rows b of table tb, by rounds of mutual best pairs: (ta, tb, a, b, sim, turn).

    ``edges`` (ta, tb, a, b, sim) are the whole matrix of a pair of tables, or the neighbour lists that a join with a bound has left; all that
    follows is over the edges there are. Each round scores the edges anew (by CSLS where ``k`` is not 0) and takes the pairs that are each
    other's best and pass seven tests: least score, and for row and column each the z-score of the best, its margin over the second, and
    the entropy of the scores. What was taken leaves with its edges by anti joins, for all pairs of tables in one plan; when a round
    takes nothing, nothing would change any more.
    """
    checkpoint_dir(edges.sparkSession)
    left, out = edges.select(*PAIR, "a", "b", "sim").checkpoint(), None
    for turn in range(rounds):
        scored = _scored(left, k).checkpoint()
        tests = (least_z, least_margin, most_entropy, z_scores)
        found = _sure(scored, "a", "b", *tests).join(_sure(scored, "b", "a", *tests), [*PAIR, "a", "b"])
        found = scored.join(found, [*PAIR, "a", "b"])
        found = (found if least_score is None else found.filter(F.col("score") >= least_score)).select(*PAIR, "a", "b", "sim", F.lit(turn).alias("turn")).checkpoint()
        out = found if out is None else out.unionByName(found)
        if not found.limit(1).count():
            break
        left = left.join(found.select(*PAIR, "a"), [*PAIR, "a"], "left_anti").join(found.select(*PAIR, "b"), [*PAIR, "b"], "left_anti").checkpoint()
    return out if out is not None else edges.select(*PAIR, "a", "b", "sim", F.lit(0).alias("turn")).limit(0)

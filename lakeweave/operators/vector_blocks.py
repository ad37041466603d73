"""Cosines between all vectors of two groups without a row for each pair.

Groups are dealt out into blocks of some ``size`` vectors by a hash of their ids. A block of queries meets a block of candidates as one product of
matrices in a task, and what leaves it for each vector is its sums over the block and its best few. Similarities are whole millionths, so their sums
are exact in any order. A pair has no similarity if one of its vectors is null, holds a null or has another length; such pairs count and come last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.sources.writers import checkpoint_dir

SIZE = 2_048
UNKNOWN = -(1 << 23)  # below all millionths of a similarity or a CSLS score
KEYS = ["pair", "qblock", "cblock"]


def dealt(q: DataFrame, c: DataFrame, size: int, few: int = 1) -> tuple[DataFrame, DataFrame]:
    """Both sides with numbers of blocks, each row once for each block of the other side. Of a smaller group up to ``few`` blocks of SIZE / 2 are made."""
    number = F.greatest(F.ceil(F.count("*") / size), F.least(F.lit(few), F.ceil(F.count("*") / (SIZE // 2))))
    n = lambda df, name: df.groupBy("pair").agg(number.alias(name))
    blocks = n(q, "_nq").join(n(c, "_nc"), "pair")
    own = lambda by, n: F.pmod(F.xxhash64(by), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = q.join(blocks, "pair").withColumn("qblock", own("qid", "_nq")).withColumn("cblock", each("_nc")).drop("_nq", "_nc")
    return left, c.join(blocks, "pair").withColumn("cblock", own("cid", "_nc")).withColumn("qblock", each("_nq")).drop("_nq", "_nc")


def parts(df: DataFrame) -> int:
    """A number of its own: blocks have few bytes and much work, and by bytes they would be put together."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def meet(q: DataFrame, c: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, size: int = SIZE) -> DataFrame:
    """``run`` of each block of queries (pair, qid, v and more) with each block of candidates (pair, cid, v and more) of the same pair, in order of ids."""
    left, right = dealt(q, c, size)
    by_block = lambda df: df.select(*[F.col(x).alias(x) for x in df.columns]).repartition(parts(q), *KEYS).groupBy(*KEYS)  # noqa: E731 (sides may share a source)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.sort_by("qid"), right.sort_by("cid")) if len(left) and len(right) else pa.table({})

    return by_block(left).cogroup(by_block(right)).applyInArrow(both, schema)


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to length 1, and their number of components; -1 for a null or one that holds a null."""
    a = column.combine_chunks()
    a = a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks)
    wide = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = a.flatten()
    m = np.zeros((len(a), max(1, wide.max(initial=1))))
    m[np.arange(m.shape[1]) < wide[:, None]] = flat.to_numpy(zero_copy_only=False)
    hollow = np.repeat(np.arange(len(a)), wide)[flat.is_null().to_numpy(zero_copy_only=False)]
    n = np.linalg.norm(m, axis=1, keepdims=True)
    wide[a.is_null().to_numpy(zero_copy_only=False)] = -1
    wide[hollow] = -1
    return m / np.where(n < 1e-12, 1.0, n), wide


def _millionths(left: pa.Table, right: pa.Table) -> np.ndarray:
    """The similarities of two blocks, UNKNOWN where there is none."""
    with np.errstate(all="ignore"):
        (q, nq), (c, nc) = _vectors(left["v"]), _vectors(right["v"])
        d = min(q.shape[1], c.shape[1])  # what lies beyond is of another length
        u = np.rint(np.nan_to_num(q[:, :d] @ c[:, :d].T, nan=0.0, posinf=0.0, neginf=0.0) * 1e6) + 0.0
    u[(nq[:, None] != nc[None, :]) | (nq < 0)[:, None]] = UNKNOWN
    return u


def _best(u: np.ndarray, k: int, ids: pa.ChunkedArray) -> tuple[pa.Array, pa.Array]:
    """The k largest of each row, as lists of ``-u`` and of ids; ids ascend along the rows, and ties go to the first."""
    n, k = u.shape[1], min(k, u.shape[1])
    key = (u - UNKNOWN) * n - np.arange(n)
    top = np.argpartition(key, n - k, axis=1)[:, n - k :] if k < n else np.tile(np.arange(n), (len(u), 1))
    offsets = pa.array(np.arange(0, top.size + 1, k), pa.int32())
    lost = pa.array(-np.take_along_axis(u, top, 1).reshape(-1).astype(np.int64))
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return pa.ListArray.from_arrays(offsets, lost), pa.ListArray.from_arrays(offsets, ids.take(pa.array(top.reshape(-1))))


def _axes(axes: str, u: np.ndarray, left: pa.Table, right: pa.Table, one: Callable) -> pa.Table:
    """``one`` (matrix, own table, own ids, other ids) for the rows, the columns or both, as a column ``axis`` says."""
    sides = {"q": (u, left, "qid", right["cid"]), "c": (u.T, right, "cid", left["qid"])}
    out = []
    for axis in axes:
        m, own, name, other = sides[axis]
        cols = one(np.ascontiguousarray(m), own, own[name], other)
        out.append(pa.table({"axis": pa.array([axis] * len(cols["id"])), **cols}))
    return pa.concat_tables(out)


def _merged(parts: DataFrame, k: int, *sums: Column) -> DataFrame:
    best = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("lost"), F.col("other"))))), 1, k)
    return parts.groupBy("axis", "id").agg(best.alias("best"), *sums)


def _kind(q: DataFrame, c: DataFrame) -> str:
    a, b = q.schema["qid"].dataType.simpleString(), c.schema["cid"].dataType.simpleString()
    if a != b:
        raise ValueError(f"ids of queries and candidates are {a} and {b}")
    return a


def statistics(q: DataFrame, c: DataFrame, k: int, axes: str = "q", size: int = SIZE) -> DataFrame:
    """(axis, id, best, n, known, s, ss, z, y) of each query (axis q) or candidate (c): its k best as (lost, other), lost being minus millionths and other
    the id, ties to the smaller; its pairs, those with a similarity, sums of their millionths and squares, of exp(sim) and sim * exp(sim)."""
    kind = _kind(q, c)

    def one(u: np.ndarray, own: pa.Table, ids: pa.ChunkedArray, other: pa.ChunkedArray) -> dict:
        lost, others = _best(u, k, other)
        known = u != UNKNOWN
        x = np.where(known, u, 0.0)
        e = np.exp(x * 1e-6) * known
        whole = lambda a: pa.array(a.astype(np.int64))
        return {
            "id": ids, "lost": lost, "other": others, "n": whole(np.full(len(u), u.shape[1])), "known": whole(known.sum(1)),
            "s": whole(x.sum(1)), "ss": whole((x * x).sum(1)), "z": pa.array(e.sum(1)), "y": pa.array((e * x).sum(1) * 1e-6),
        }

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _axes(axes, _millionths(left, right), left, right, one)

    schema = f"axis string, id {kind}, lost array<long>, other array<{kind}>, n long, known long, s long, ss long, z double, y double"
    parts = meet(q, c, run, schema, size)
    exact = lambda name: F.sum(F.col(name).cast("decimal(20,0)")).alias(name)
    return _merged(parts, k, F.sum("n").alias("n"), F.sum("known").alias("known"), exact("s"), exact("ss"), F.sum("z").alias("z"), F.sum("y").alias("y"))


def entropy(stats: DataFrame) -> DataFrame:
    """(axis, id, entropy): of the softmax of the similarities, over ln(n); 0 for one pair."""
    value = F.round((F.log("z") - F.col("y") / F.col("z")) / F.log("n"), 6)
    return stats.select("axis", "id", F.when(F.col("n") <= 1, F.lit(0.0)).when(F.col("known") > 0, value).alias("entropy"))


def diagnostics(stats: DataFrame) -> DataFrame:
    """(axis, id, best, sim, z, margin): best partner and its similarity, z-score (population deviation), margin to the second over the deviation
    (infinite for one pair). ``stats`` hold two best at least."""
    far = lambda i: F.get("best", F.lit(i))["lost"]
    u = lambda i: F.when(far(i) != -UNKNOWN, -far(i))
    wide = lambda c: c.cast("decimal(20,0)")
    d = F.sqrt((wide(F.col("known")) * F.col("ss") - F.col("s") * F.col("s")).cast("double"))  # times known
    x = stats.withColumns({"_d": F.when(F.col("known") > 0, d), "_1": u(0), "_2": u(1)})
    over = lambda c: F.when(F.col("_d") == 0, F.lit(0.0)).otherwise(F.round(c / F.col("_d"), 6))
    z = over((wide(F.col("_1")) * F.col("known") - F.col("s")).cast("double"))
    margin = F.when(F.col("n") == 1, F.lit(float("inf"))).otherwise(over(((F.col("_1") - F.col("_2")) * F.col("known")).cast("double")))
    return x.select("axis", "id", F.get("best", F.lit(0))["other"].alias("best"), (F.col("_1") / 1e6).alias("sim"), z.alias("z"), margin.alias("margin"), F.col("_1").alias("top"), (F.col("_d") / F.col("known")).alias("deviation"), "n")


def sharpness(q: DataFrame, c: DataFrame, wanted: DataFrame, size: int = SIZE) -> DataFrame:
    """(axis, id, entropy) of the softmax of z-scores, for ``wanted`` (axis, id, top, deviation, n) alone, the last three as ``diagnostics`` gives them."""
    kind = _kind(q, c)

    def one(u: np.ndarray, own: pa.Table, ids: pa.ChunkedArray, other: pa.ChunkedArray) -> dict:
        top, d = (own[name].to_numpy().astype(np.float64) for name in ("top", "deviation"))
        at = np.nonzero(~np.isnan(top))[0]
        x = (u[at] - top[at, None]) / np.where(d[at] < 1e-6, 1e6, d[at])[:, None]
        e = np.exp(x) * (u[at] != UNKNOWN)
        return {"id": ids.take(pa.array(at)), "z": pa.array(e.sum(1)), "y": pa.array((e * x).sum(1))}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        has = "".join(a for a, t in (("q", left), ("c", right)) if t["top"].null_count < len(t))
        if not has:
            return pa.table({})
        return _axes(has, _millionths(left, right), left, right, one)

    asked = lambda df, axis, by: df.join(wanted.filter(F.col("axis") == axis).select(F.col("id").alias(by), "top", "deviation"), by, "left")
    parts = meet(asked(q, "q", "qid"), asked(c, "c", "cid"), run, f"axis string, id {kind}, z double, y double", size)
    sums = parts.groupBy("axis", "id").agg(F.sum("z").alias("z"), F.sum("y").alias("y")).join(wanted.select("axis", "id", "n"), ["axis", "id"])
    return entropy(sums.withColumn("known", F.lit(1)))


def mutual(best: DataFrame) -> DataFrame:
    """(qid, cid, and the other columns of the query): those that are each other's ``best``, of rows (axis, id, best, ...)."""
    q = best.filter("axis = 'q'").withColumnsRenamed({"id": "qid", "best": "cid"}).drop("axis")
    return q.join(best.filter("axis = 'c'").select(F.col("best").alias("qid"), F.col("id").alias("cid")), ["qid", "cid"])


def accepted(q: DataFrame, c: DataFrame, least_score: float, least_z: float, least_margin: float, most_entropy: float, size: int = SIZE) -> DataFrame:
    """(qid, cid, sim): mutual best pairs that are sure from both sides, by score, z-score of the best, margin and entropy of z-scores.

    Entropies need the deviations, so blocks meet twice, the second time for the vectors alone that are left.
    """
    checkpoint_dir(q.sparkSession)
    of = diagnostics(statistics(q, c, 2, "qc", size)).checkpoint()
    sure = of.filter((F.col("z") >= least_z) & (F.col("margin") >= least_margin))
    left = sure.filter("axis = 'q'").select(F.col("id").alias("qid"))
    right = sure.filter("axis = 'c'").select(F.col("id").alias("cid"))
    pairs = mutual(of).filter(F.col("sim") >= least_score).select("qid", "cid", "sim").join(left, "qid", "left_semi").join(right, "cid", "left_semi").checkpoint()
    ends = pairs.select(F.lit("q").alias("axis"), F.col("qid").alias("id")).unionByName(pairs.select(F.lit("c").alias("axis"), F.col("cid").alias("id")))
    sharp = sharpness(q, c, of.join(ends, ["axis", "id"], "left_semi"), size).filter(F.col("entropy") <= most_entropy).checkpoint()
    for axis, by in (("q", "qid"), ("c", "cid")):
        pairs = pairs.join(sharp.filter(F.col("axis") == axis).select(F.col("id").alias(by)), by, "left_semi")
    return pairs.select("qid", "cid", "sim")


def with_means(q: DataFrame, c: DataFrame, k: int, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """``q`` and ``c`` with ``m``, the mean similarity of each vector's k best, of min(k, n) values."""
    checkpoint_dir(q.sparkSession)
    some = F.filter("best", lambda x: x["lost"] != -UNKNOWN)
    mean = F.aggregate(some, F.lit(0).cast("long"), lambda s, x: s - x["lost"]) / F.nullif(F.size(some), F.lit(0)) / 1e6
    means = statistics(q, c, k, "qc", size).select("axis", "id", mean.alias("m")).checkpoint()
    return tuple(df.join(means.filter(F.col("axis") == axis).select(F.col("id").alias(by), "m"), by) for df, axis, by in ((q, "q", "qid"), (c, "c", "cid")))


def _csls(u: np.ndarray, left: pa.Table, right: pa.Table) -> np.ndarray:
    """2 sim less both means, in millionths, halves away from zero."""
    m, n = (t["m"].to_numpy().astype(np.float64) for t in (left, right))
    x = (2 * (u / 1e6) - m[:, None] - n[None, :]) * 1e6
    return np.where(u == UNKNOWN, UNKNOWN, np.trunc(x + np.copysign(0.5, x)) + 0.0)


def csls(q: DataFrame, c: DataFrame, k: int, size: int = 8 * SIZE) -> DataFrame:
    """(qid, cid, sim, csls) of all pairs: 2 sim - mean of the query's k best - mean of the candidate's k best.

    Blocks are large, as each vector is written once for each block of the other side; pairs leave them in pieces of SIZE / 2 by SIZE / 2 vectors.
    """
    kind = _kind(q, c)
    q, c = with_means(q, c, k)
    left, right = dealt(q, c, size, 8)
    side = lambda df, by, own: df.select(*KEYS, F.lit(own).alias("own"), F.col(by).alias("id"), "v", "m")
    both = side(left, "qid", 0).unionByName(side(right, "cid", 1))

    def piece(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        u = _millionths(left, right)
        x, none = _csls(u, left, right), (u == UNKNOWN).reshape(-1)
        value = lambda a: pa.array(a.reshape(-1) / 1e6, mask=none)
        rows, cols = np.repeat(np.arange(len(left)), len(right)), np.tile(np.arange(len(right)), len(left))
        out = pa.table({"qid": left["id"].take(pa.array(rows)), "cid": right["id"].take(pa.array(cols)), "sim": value(u), "csls": value(x)})
        yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        left, right = (rows.filter(pc.equal(rows["own"], own)) for own in (0, 1))
        for i in range(0, len(left), SIZE // 2):
            for j in range(0, len(right), SIZE // 2):
                yield from piece(left.slice(i, SIZE // 2), right.slice(j, SIZE // 2))

    return both.repartition(parts(q), *KEYS).groupBy(*KEYS).applyInArrow(run, f"qid {kind}, cid {kind}, sim double, csls double")


def mutual_csls(q: DataFrame, c: DataFrame, k: int, size: int = SIZE) -> DataFrame:
    """(qid, cid, csls): pairs that are each other's best by CSLS; ties go to the smaller id."""
    kind = _kind(q, c)
    q, c = with_means(q, c, k, size)

    def one(x: np.ndarray, own: pa.Table, ids: pa.ChunkedArray, other: pa.ChunkedArray) -> dict:
        lost, others = _best(x, 1, other)
        return {"id": ids, "lost": lost, "other": others}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _axes("qc", _csls(_millionths(left, right), left, right), left, right, one)

    best = _merged(meet(q, c, run, f"axis string, id {kind}, lost array<long>, other array<{kind}>", size), 1)
    first = F.get("best", F.lit(0))
    best = best.select("axis", "id", first["other"].alias("best"), F.when(first["lost"] != -UNKNOWN, -first["lost"] / 1e6).alias("csls"))
    return mutual(best).select("qid", "cid", "csls")

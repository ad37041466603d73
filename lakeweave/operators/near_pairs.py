"""Pairs of near vectors of two sides of any size, without a row for each pair that is looked at.

Both sides are dealt out into blocks by ``vector_blocks.meet``. Within two blocks a product of matrices in single precision says which pairs can
still count, by the stated threshold or by the k-th best that each query has so far; those alone are scored in double precision, tested and kept.
What leaves a task is each query's best few of a block, or the pairs over the threshold. Time grows with the product of both sides, memory does not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector_blocks
from .graph import spanning
from .vector_join import top_k

LEAST, MOST, BLOCKS = 512, 49_152, 64  # vectors of a block; about so many pairs of blocks there are at least
ROWS, COLUMNS = 1_024, 8_192  # of one product
SLACK = 2e-5  # more than single precision loses, of the product of two lengths
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}


def block_size(nq: int, nc: int) -> int:
    return int(min(MOST, max(LEAST, math.sqrt(nq * nc / BLOCKS))))


def matrix(column: pa.ChunkedArray, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, for cosines of length 1 (no length, and all 0, if it is not finite), and the lengths that they have now."""
    a = column.combine_chunks()
    a = a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks)
    m = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)
    n = np.linalg.norm(m, axis=1)
    if cosine:
        m = m / np.where(n < 1e-12, 1.0, n)[:, None]
        m[~np.isfinite(n)] = 0.0
        n = np.linalg.norm(m, axis=1)
    return m, n


def codes_of(m: np.ndarray, planes: list[list[list[float]]]) -> np.ndarray:
    """The bucket of each vector in each table: the signs of its products with the table's planes."""
    flat, tables, bits = np.array([p for t in planes for p in t]), len(planes), len(planes[0])
    return ((m @ flat.T > 0).reshape(-1, tables, bits) * (1 << np.arange(bits))).sum(2).astype(np.min_scalar_type((1 << bits) - 1))


def _best(i: np.ndarray, j: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each i, by score descending (NaN first, as Spark has it), then j."""
    order = np.lexsort((j, -np.where(np.isnan(s), np.inf, s), i))
    i, j, s = i[order], j[order], s[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
    keep = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
    return i[keep], j[keep], s[keep]


def near_pairs(
    q: DataFrame, c: DataFrame, k: int | None = None, threshold: float | None = None, cosine: bool = True, planes: list[list[list[float]]] | None = None,
    radius: int = 1, least: int = 2, ordered: bool = False, digits: int = 6, size: int | None = None, forest: bool = False,
) -> DataFrame:
    """(qid, qgroup, cid, cgroup, score) of (qid, qgroup, v) with (cid, cgroup, v): each query's k best, with their ``rank``, or all of score >= threshold.

    The score is the rounded cosine or dot product; ties go to the least cid, and pairs of one group are left out. With ``planes`` pairs count
    that meet in ``least`` tables of buckets, whose codes differ by at most ``radius`` bits. ``ordered`` keeps pairs of qid < cid alone. With ``forest`` (and a threshold)
    only so many pairs of two blocks are kept as join the same vectors, fewer than the blocks have vectors.
    """
    q, c = q.select("qid", "qgroup", "v").filter("v is not null"), c.select("cid", "cgroup", "v").filter("v is not null")
    kinds = {f.name: f.dataType.simpleString() for f in [*q.schema, *c.schema]}
    schema = pa.schema([(n, ARROW[kinds[n]]) for n in ("qid", "qgroup", "cid", "cgroup")] + [("score", pa.float64())])
    text = ", ".join(f"{n} {kinds[n]}" for n in schema.names[:4]) + ", score double"
    size = size or block_size(q.count(), c.count())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (a, na), (b, nb) = matrix(left["v"], cosine), matrix(right["v"], cosine)
        ids = [left["qid"].to_numpy(), left["qgroup"].to_numpy(), right["cid"].to_numpy(), right["cgroup"].to_numpy()]
        if ordered and ids[0][0] >= ids[2][-1]:
            return schema.empty_table()
        with np.errstate(all="ignore"):
            wild_a, wild_b = ~(na < 1e15), ~(nb < 1e15)  # lengths that single precision does not hold
            fa, fb = np.where(wild_a[:, None], 0, a).astype(np.float32), np.where(wild_b[:, None], 0, b).astype(np.float32)
        ca, cb = (codes_of(a, planes), codes_of(b, planes)) if planes else (None, None)
        longest = np.where(wild_b, 0, nb).max(initial=0)
        out = []

        def counts(i, j) -> np.ndarray:
            """Which pairs count: of all rows and columns of two slices, or of two lists of numbers."""
            x, y = ((lambda v: v[i][:, None]), (lambda v: v[j][None])) if isinstance(i, slice) else ((lambda v: v[i]), (lambda v: v[j]))
            ok = x(ids[1]) != y(ids[3])
            if ordered:
                ok &= x(ids[0]) < y(ids[2])
            if planes:
                ok &= sum((np.bitwise_count(x(ca[:, t]) ^ y(cb[:, t])) <= radius).astype(np.int8) for t in range(len(planes))) >= least
            return ok

        def thinned(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keep = spanning(i, j, len(a), len(b))
            return i[keep], j[keep], s[keep]

        for at in range(0, len(a), ROWS):
            rows = slice(at, min(at + ROWS, len(a)))
            slack = (SLACK * np.where(wild_a, 0, na)[rows] * longest + 10.0**-digits).astype(np.float32)
            floor = np.full(rows.stop - at, -np.inf if threshold is None else threshold, np.float32)
            held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for begin in range(0, len(b), COLUMNS):
                columns = slice(begin, min(begin + COLUMNS, len(b)))
                about = fa[rows] @ fb[columns].T
                about[wild_a[rows]] = np.inf
                about[:, wild_b[columns]] = np.inf
                if k is not None and begin == 0 and about.shape[1] > k:  # a first bound: the k-th best of these, which are not wild
                    sure = np.where(counts(rows, columns) & (about < np.inf), about, -np.inf)
                    floor = np.maximum(floor, np.partition(sure, -k, axis=1)[:, -k] - slack)
                i, j = np.divmod(np.flatnonzero(about >= (floor - slack)[:, None]), about.shape[1])
                i, j = i + at, j + begin
                ok = counts(i, j)
                i, j = i[ok], j[ok]
                with np.errstate(all="ignore"):
                    s = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", a[i[x : x + 65_536]], b[j[x : x + 65_536]]) for x in range(0, len(i), 65_536))])
                    s = np.round(s, digits) + 0.0
                if threshold is not None:
                    i, j, s = (x[s >= threshold] for x in (i, j, s))
                held = tuple(map(np.concatenate, zip(held, (i, j, s), strict=True)))
                if forest:
                    held = thinned(*held)
                if k is not None:
                    held = _best(*held, k)
                    full = np.bincount(held[0] - at, minlength=len(floor)) >= k
                    low = np.full(len(floor), np.inf)
                    np.minimum.at(low, held[0] - at, np.where(np.isnan(held[2]), np.inf, held[2]))
                    floor = np.where(full, low, -np.inf if threshold is None else threshold).astype(np.float32)
            out.append(held)
        i, j, s = map(np.concatenate, zip(*out, strict=True))
        if forest:
            i, j, s = thinned(i, j, s)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip((ids[0][i], ids[1][i], ids[2][j], ids[3][j], s), schema.types, strict=True)], schema=schema)

    own = lambda df: df.select(F.lit(0).alias("pair"), "*")
    pairs = vector_blocks.meet(own(q), own(c), run, text, size)
    return top_k(pairs, ["qid"], k, F.col("score").desc(), F.col("cid")) if k is not None else pairs


def row_cosines(df: DataFrame, a: str, b: str, name: str = "sim", digits: int = 6) -> DataFrame:
    """``df`` with the rounded cosine of each row's vectors ``a`` and ``b`` in their place: ``vectors.cosine``, a batch at a time."""
    rest = [f for f in df.schema if f.name not in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                with np.errstate(all="ignore"):
                    (m, wide), (n, other) = (vector_blocks._vectors(pa.chunked_array([x.column(c)])) for c in (a, b))
                    d = min(m.shape[1], n.shape[1])
                    s = np.einsum("ij,ij->i", m[:, :d], n[:, :d])
                s = np.round(np.where(np.isfinite(s), s, 0.0), digits) + 0.0
                known = (wide == other) & (wide >= 0)
                yield pa.RecordBatch.from_arrays([*(x.column(f.name) for f in rest), pa.array(s, mask=~known)], names=[*(f.name for f in rest), name])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + f", {name} double")

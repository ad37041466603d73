"""Compression of vectors to codes of their parts (product quantisation) on integers.

Components become integers, floor(scale * x), and each vector is cut into equal parts of neighbouring components. The kept
rows are written once as columnar blocks: one array of integers per component, some thousand rows long. Each round is one
``treeAggregate`` over the RDD of blocks. A block's distances to a part's codebook accumulate dimension by dimension; each row
takes the nearest entry; ``np.add.at`` adds the rows to int64 tensors of sums and counts, which merge pairwise up a
reduction tree. All sums are of integers, so the codebooks are the same on any partitioning and in any order of merging.
The driver holds one codebook and one tensor of sums: entries x components numbers, whatever the number of rows.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite component are dropped, and so are rows whose
vector is not as long as that of the smallest kept id (null ids come last). A length that the parts don't divide is filled up with
zeros. Scaled components are held to +-2**27, so that squares of up to 2**7 components add up in a long (for longer vectors the
bound is lower). The first codebook comes from the smallest ids, of equal ids from the smaller vectors; repeated rows are each
coded and counted. With fewer rows than entries the codebooks have as many entries as rows. An empty table gives an
empty result. Equal labels are those that read equal as text, nulls together; their sums are of decimals and stop at the
largest long. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import by_key, documents, spread, stash

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
LONG_MAX = (1 << 63) - 1
WIDE_TREE = 4_096  # from so many partitions on, sums merge over one more level


def kept_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, v (array of doubles): rows with finite vectors, whatever their length."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).filter((F.size("v") > 0) & F.coalesce(finite, F.lit(False)))


def bound(dims: int) -> int:
    """The largest absolute component: dims * (2 * bound)**2 is less than 2**63."""
    return 1 << min(27, (60 - max(0, dims - 1).bit_length()) // 2)


def integers(matrix: np.ndarray, scale: float, parts: int) -> np.ndarray:
    """Integer components, dimension-major (dimensions, rows), filled up to a multiple of ``parts`` dimensions."""
    most = bound(matrix.shape[1])
    with np.errstate(over="ignore"):
        ints = np.clip(np.floor(scale * matrix), -most, most).astype(np.int32).T
    return np.pad(ints, ((0, -ints.shape[0] % parts), (0, 0)))


def blocks(kept: DataFrame, dims: int, scale: float, parts: int) -> DataFrame:
    """Columnar blocks: ids, labels and the integers of all parts, of as many rows as an Arrow batch has."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ints = integers(flat.reshape(b.num_rows, dims), scale, parts)
                whole = pa.array([0, b.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, b.column(0)), pa.ListArray.from_arrays(whole, b.column(1)), pa.array([ints.tobytes()], pa.binary())], names=["ids", "labels", "ints"])

    return kept.filter(F.size("v") == dims).mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, ints binary")


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one part, (dimensions of the part, rows) and its codebook (entries, dimensions): entry and squared distance of each row."""
    away = np.zeros((book.shape[0], block.shape[1]), np.int64)
    for j in range(block.shape[0]):  # one dimension at a time
        away += (block[j][None, :].astype(np.int64) - book[:, j][:, None]) ** 2
    entry = away.argmin(0)  # ties: the lower index
    return entry, away[entry, np.arange(block.shape[1])]


def unpacked(ints: bytes, dims: int, parts: int) -> np.ndarray:
    """(parts, dimensions of a part, rows)."""
    return np.frombuffer(ints, np.int32).reshape(parts, dims // parts, -1)


def train(table: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, dimensions of a part) after so many rounds over the table of blocks."""
    parts, entries, width = books.shape
    data = table.select("ints").rdd.map(lambda r: bytes(r.ints))
    depth = 3 if data.getNumPartitions() >= WIDE_TREE else 2

    for _ in range(rounds):
        held = books

        def add(total: tuple | None, ints: bytes, held: np.ndarray = held) -> tuple:
            sums, counts = total or (np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64))
            for p, block in enumerate(unpacked(ints, parts * width, parts)):
                entry, _ = nearest(block, held[p])
                np.add.at(sums[p], entry, block.T)
                np.add.at(counts[p], entry, 1)
            return sums, counts

        def merge(a: tuple | None, b: tuple | None) -> tuple | None:
            return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

        total = data.treeAggregate(None, add, merge, depth)
        if total:
            sums, counts = total
            books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def assign(table: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code and error of each row of the blocks."""
    parts, _, width = books.shape
    kinds = {f.name: f.dataType.elementType.simpleString() for f in table.schema if f.name != "ints"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = np.array([f"{i:02x}" for i in range(256)])
        for b in batches:
            for k in range(b.num_rows):
                cut = unpacked(b.column(2)[k].as_py(), parts * width, parts)
                found = [nearest(cut[p], books[p]) for p in range(parts)]
                codes = ["".join(c) for c in hexes[np.stack([entry for entry, _ in found], 1)]]
                errors = np.sum([away for _, away in found], axis=0)
                yield pa.RecordBatch.from_arrays([b.column(0)[k].values, b.column(1)[k].values, pa.array(codes), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    return table.mapInArrow(run, f"id {kinds['ids']}, label {kinds['labels']}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of each kept row, stashed, and the codebooks (parts, entries, dimensions of a part)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    kept = kept_rows(vectors, id_col, vec_col, label_col)
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = kept.select(F.col("id"), F.size("v").alias("n")).orderBy(order[0], "n").first()
    dims = first.n if first else parts
    seeds = kept.filter(F.size("v") == dims).select("id", "v").orderBy(*order).limit(entries).collect()
    table = stash(blocks(spread(kept), dims, scale, parts))
    books = integers(np.array([r.v for r in seeds], np.float64).reshape(len(seeds), dims), scale, parts).T.astype(np.int64)
    books = books.reshape(len(seeds), parts, -(-dims // parts)).swapaxes(0, 1)
    if seeds:
        books = train(table, books, rounds)
    return stash(assign(table, books)), books


def label_errors(codes: DataFrame) -> DataFrame:
    """The codes with the sum of errors over all rows of the same label: partial sums by label, joined back without a hot task."""
    key = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    keyed = codes.withColumn("_label", key)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    sums = stash(keyed.groupBy("_label").agg(total.alias("label_error"), F.count("*").alias("_n")))
    return by_key(keyed, sums, "_label", "_n").drop("_label", "_n")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(documents(spark, sf_dir, "embeddings"))
    digest = sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return label_errors(codes).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    parts = [
        "k AS MATERIALIZED (SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v, len(embedding) // 8 AS w FROM embeddings "
        "WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        "x AS MATERIALIZED (SELECT vec_id, p, v[p * w + 1 : (p + 1) * w] AS v FROM k, range(8) r(p))",
        "s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 16)",
        "b0 AS MATERIALIZED (SELECT x.p, s.e, x.v FROM x JOIN s USING (vec_id))",
    ]
    near = "SELECT vec_id, p, e, d FROM (SELECT x.vec_id, x.p, b.e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x.v, b.v)]) AS d FROM x JOIN {} b USING (p)) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1"
    for r in range(ROUNDS):
        parts += [
            f"n{r} AS ({near.format(f'b{r}')})",
            f"m{r} AS (SELECT p, e, list(c ORDER BY i) AS v FROM (SELECT n.p, n.e, i, (sum(x.v[i]) - ((sum(x.v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS c "
            f"FROM n{r} n JOIN x USING (vec_id, p), range(1, 1 + len(x.v)) t(i) GROUP BY n.p, n.e, i) GROUP BY p, e)",
            f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v::BIGINT[], b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (p, e))",
        ]
    parts += [
        f"f AS MATERIALIZED ({near.format(f'b{ROUNDS}')})",
        f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})",
        "c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY vec_id)",
    ]
    return f"WITH {', '.join(parts)} SELECT c.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, h.h AS codebooks_sha256 FROM c JOIN k USING (vec_id), h"


OP11_SQL = _sql()

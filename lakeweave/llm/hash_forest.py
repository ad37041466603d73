"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree hashes a vector to a string of 64 bits, the sides of its own hyperplanes on which the vector lies. A tree is one sorted array of
these strings: rows are dealt by ranges of (tree, string), sorted within, and written in blocks of a fixed number of
rows with their vectors. The vectors of one prefix, however long, are a run of that array. A directory holds the string at
every so many rows. It is thinned to DIRECTORY entries at most, however many rows there are, and so fits in a broadcast.

A search descends in each tree to the longest prefix that its string shares with the array (a binary search), and then ascends in all
trees at once: from the longest prefix on, all trees drop one more bit until together they hold ``budget`` rows. The
query goes to the blocks that the runs of that prefix touch, in all trees, and meets there the rows of its runs only. Blocks
answer with their best few of each query; no list of candidates is ever made. If the whole forest has fewer rows than the budget, the
ascent ends at the roots and the search is exact.

The budget grows as COST * rows**GROWTH. For vectors with no structure whose near neighbours have a cosine of a half, a
bit is shared with probability 2/3 by a near and 1/2 by a far one, and log(2/3) / log(1/2) = 0.585 is the growth that keeps
recall; vectors with structure need less, and the budget is a parameter. Hyperplanes pass through the mean direction of CENTRE rows, those
of the smallest ids.

Equal vectors are one class: the forest holds each once, under the smallest id, and a class answers with its smallest k + 1
ids. Vectors that only hash alike to the last bit stay rows of their own, in as many blocks as they need; nothing is cut off.

Defined cases: null, empty and zero vectors, those with null or non-finite components, those with null ids and those not as long
as the vector of the smallest kept id take no part; of rows with the same id the one with the smallest vector stays. Ties go to the smaller id. With
fewer candidates than k all are returned; an empty table gives an empty result. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import by_key, documents, repeated_ids, spread, stash

TREES, BITS, COST, GROWTH = 16, 64, 45.0, 0.6
BLOCK, STEP, DIRECTORY, CENTRE = 1_024, 128, 1 << 18, 4_096
PACK, GATHER = 256, 4_096  # queries that go to a block in one row; queries whose ways are found at once
SLIP = 1e-12  # what a product of matrices may be off; all that come so near to the best few are computed again, one by one
FLUSH = 4 << 20
SIGN = np.uint64(1 << 63)


def kept_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array of doubles): rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    first = kept.select("id", F.size("v").alias("n")).orderBy("id", "n").first()
    kept = kept.filter(F.size("v") == (first.n if first else 0))
    return kept.groupBy("id").agg(F.min("v").alias("v")) if repeated_ids(kept, "id") else kept


def planes(dims: int, trees: int, seed: int) -> np.ndarray:
    """(dims, trees * BITS): directions of the hyperplanes, at right angles to each other by sets of ``dims`` within a tree."""
    r = np.random.default_rng(seed)
    sets = [[np.linalg.qr(r.normal(size=(dims, dims)))[0] for _ in range(-(-BITS // dims))] for _ in range(trees)]
    return np.concatenate([np.concatenate(own, 1)[:, :BITS] for own in sets], 1)


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1: cosines stay what they are, squares neither overflow nor vanish."""
    high = np.abs(matrix).max(axis=1, keepdims=True, initial=0)
    return np.ldexp(matrix, -np.frexp(high)[1])


def unit(matrix: np.ndarray) -> np.ndarray:
    m = scaled(matrix)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def strings(matrix: np.ndarray, plane: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """(rows, trees): the bit strings as unsigned numbers; they sort as the strings do."""
    sides = np.stack([(unit(matrix) - centre) @ plane[:, k : k + BITS] > 0 for k in range(0, plane.shape[1], BITS)], 1)
    return np.packbits(sides, axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned numbers as longs of the same order."""
    return (h ^ SIGN).view(np.int64)


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def in_bytes(kept: DataFrame) -> DataFrame:
    """id, v (the bytes of its doubles), key (a digest of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in matrix_of(b.column(1))], pa.binary())], names=["id", "v"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, v binary").withColumn("key", F.sha2("v", 256))


def forest(reps: DataFrame, plane: np.ndarray, centre: np.ndarray, step: int, block: int) -> DataFrame:
    """The sorted arrays in blocks of ``block`` rows, stashed: tree, unit, marks, strings, ids and vectors.

    Entries of the directory have ``step`` rows. A unit is what is read together: a block, or the blocks of one entry where that is longer.
    ``marks`` has the entries that the block belongs to: their number in the unit, first string and rows.
    """
    kind = reps.schema["rep"].dataType.simpleString()
    trees = plane.shape[1] // BITS

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = signed(strings(vectors_of(b.column(1), plane.shape[0]), plane, centre))
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(h[:, t]), b.column(0), b.column(1)], names=["tree", "h", "id", "v"])

    def emit(rows: pa.Table, at: int, unit: int) -> pa.RecordBatch:
        h, ids = rows["h"].to_numpy(), rows["id"].combine_chunks()
        marks = [{"i": i // step, "h": int(h[i]), "n": min(step, len(h) - i)} for i in range(0, len(h), step)]
        columns = [
            pa.array([rows["tree"][0].as_py()], pa.int32()),
            pa.array([rows["part"][0].as_py() << 32 | unit], pa.int64()),
            pa.array([at], pa.int64()),
            pa.array([marks], pa.list_(pa.struct([("i", pa.int64()), ("h", pa.int64()), ("n", pa.int64())]))),
            pa.array([h.tobytes()], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(h)], pa.int32()), ids),
            pa.array([b"".join(rows["v"].to_pylist())], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["tree", "unit", "at", "marks", "h", "ids", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree, at, unit = None, None, 0, -1
        for b in batches:
            of = b.column(0).to_numpy()
            for run in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):  # rows of one tree
                if not len(run):
                    continue
                if of[run[0]] != tree:
                    if held is not None and held.num_rows:
                        unit += at % max(step, block) == 0
                        yield emit(held, at, unit)
                    held, tree, at = None, of[run[0]], 0
                own = pa.Table.from_batches([b.slice(int(run[0]), len(run))])
                held = own if held is None else pa.concat_tables([held, own])
                while held.num_rows >= block:
                    unit += at % max(step, block) == 0
                    yield emit(held.slice(0, block), at, unit)
                    held, at = held.slice(block), at + block
        if held is not None and held.num_rows:
            yield emit(held, at, unit + (at % max(step, block) == 0))

    rows = reps.select("rep", "v").mapInArrow(hashed, f"tree int, h long, id {kind}, v binary")
    dealt = rows.repartitionByRange("tree", "h", "id").sortWithinPartitions("tree", "h", "id").withColumn("part", F.spark_partition_id().cast("long"))
    return stash(dealt.mapInArrow(cut, f"tree int, unit long, at long, marks array<struct<i:long,h:long,n:long>>, h binary, ids array<{kind}>, v binary"))


def vectors_of(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


class Directory:
    """For each tree the first string, the rows before it and the unit of each entry, in order."""

    def __init__(self, blocks: DataFrame, trees: int):
        marks = blocks.select("tree", "unit", F.explode("marks").alias("m"))
        entries = marks.groupBy("tree", "unit", F.col("m.i").alias("i")).agg(F.min("m.h").alias("h"), F.sum("m.n").alias("n")).collect()
        entries.sort(key=lambda e: (e.tree, e.h, e.unit, e.i))
        self.first, self.before, self.unit = [], [], []
        for t in range(trees):
            own = [e for e in entries if e.tree == t]
            self.first.append(np.array([e.h for e in own], np.int64))
            self.before.append(np.cumsum([0] + [e.n for e in own]))
            self.unit.append(np.array([e.unit for e in own], np.int64))

    def ways(self, h: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
        """For strings (queries, trees): the first and last string of each run at which the ascent ends, and the units it touches."""
        rest = np.array([(1 << BITS - n) - 1 for n in range(BITS + 1)], np.uint64)  # the bits behind a prefix of n
        low, high = signed(h[:, :, None] & ~rest), signed(h[:, :, None] | rest)
        total = np.zeros((len(h), BITS + 1), np.int64)
        ends = []
        for t, (first, before) in enumerate(zip(self.first, self.before, strict=True)):
            a, b = np.searchsorted(first, low[:, t], "left"), np.searchsorted(first, high[:, t], "right")
            total += before[np.maximum(b - 1, a)] - before[a]  # entries that lie in the run as a whole
            total[:, 0] += before[-1] - (before[np.maximum(b - 1, a)] - before[a])[:, 0]
            ends.append((a, b))
        enough = total >= budget
        level = np.where(enough.any(1), BITS - enough[:, ::-1].argmax(1), 0)  # the longest prefix with so many rows
        rows = np.arange(len(h))
        units = [[np.unique(self.unit[t][max(a[i, n] - 1, 0) : b[i, n]]) for t, (a, b) in enumerate(ends)] for i, n in zip(rows, level, strict=True)]
        return low[rows, :, level], high[rows, :, level], units


def packs(queries: DataFrame, plane: np.ndarray, centre: np.ndarray, directory: Directory, budget: int) -> DataFrame:
    """The queries (id, v) of each unit, PACK to a row, with the strings between which each one searches."""
    kind, dims, trees = queries.schema["id"].dataType.simpleString(), plane.shape[0], plane.shape[1] // BITS
    held = queries.sparkSession.sparkContext.broadcast(directory)

    def sent(ids: pa.Array, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        low, high, units = held.value.ways(strings(m, plane, centre), budget)
        to = [(u, t, i) for i, own in enumerate(units) for t in range(trees) for u in own[t].tolist()]
        to.sort()
        out, size, at = [], 0, 0
        while at < len(to):
            end = at
            while end < len(to) and to[end][0] == to[at][0] and end - at < PACK:
                end += 1
            t, who = to[at][1], [x[2] for x in to[at:end]]
            out.append((to[at][0], ids.take(pa.array(who)), low[who, t].tobytes(), high[who, t].tobytes(), m[who].tobytes()))
            size += len(out[-1][-1])
            at = end
            if size >= FLUSH or at == len(to):
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x[1]) for x in out]), pa.int32()), pa.concat_arrays([x[1] for x in out]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), lists, *(pa.array([x[k] for x in out], pa.binary()) for k in (2, 3, 4))], names=["unit", "qids", "low", "high", "qv"])
                out, size = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []
        for b in batches:
            own.append(b)
            if sum(x.num_rows for x in own) >= GATHER:
                yield from sent(pa.concat_arrays([x.column(0) for x in own]), np.concatenate([vectors_of(x.column(1), dims) for x in own]))
                own = []
        if sum(x.num_rows for x in own):
            yield from sent(pa.concat_arrays([x.column(0) for x in own]), np.concatenate([vectors_of(x.column(1), dims) for x in own]))

    return queries.select("id", "v").mapInArrow(run, f"unit long, qids array<{kind}>, low binary, high binary, qv binary")


def best_of_block(q: np.ndarray, low: np.ndarray, high: np.ndarray, h: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the k best rows of each query within its run; ties go to the smaller id."""
    a, b = np.searchsorted(h, low, "left"), np.searchsorted(h, high, "right")
    place = np.arange(len(h))
    inside = (place >= a[:, None]) & (place < b[:, None])
    rough = np.where(inside, unit(q) @ unit(m).T, -2.0)
    least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -2.0)
    i, j = np.nonzero(inside & (rough >= least[:, None] - SLIP))
    x, y = scaled(q)[i], scaled(m)[j]
    score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    few = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return i[few], j[few], score[few]


def search(blocks: DataFrame, sent: DataFrame, dims: int, k: int) -> DataFrame:
    """(qid, id, score): the k best of each query and block."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                qids, ids = b.column(0)[r].values, b.column(5)[r].values
                low, high, h = (np.frombuffer(b.column(c)[r].as_py(), np.int64) for c in (1, 2, 4))
                q, m = (np.frombuffer(b.column(c)[r].as_py(), np.float64).reshape(-1, dims) for c in (3, 6))
                i, j, score = best_of_block(q, low, high, h, ids.to_numpy(zero_copy_only=False), m, k)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(score)], names=["qid", "id", "score"])

    pairs = sent.join(blocks, "unit").select("qids", "low", "high", "qv", "h", "ids", "v")
    return pairs.mapInArrow(run, f"qid {kind}, id {kind}, score double")


def nearest(vectors: DataFrame, asked: str, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, cost: float = COST, growth: float = GROWTH, block: int = BLOCK, step: int = STEP, seed: int = 13) -> DataFrame:
    """(qid, rank, id, score): the k nearest other rows of each row that meets the condition ``asked`` on ``id``.

    ``block`` and ``step`` are powers of two; the search holds cost * rows**growth rows of all trees together.
    """
    rows = stash(in_bytes(spread(kept_rows(vectors, id_col, vec_col))))
    reps = stash(rows.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("v")))
    sample = reps.select("rep", "v").orderBy("rep").limit(CENTRE).collect()
    kind = rows.schema["id"].dataType.simpleString()
    if not sample:
        return rows.sparkSession.createDataFrame([], f"qid {kind}, rank int, id {kind}, score double")
    directions = unit(np.array([np.frombuffer(r.v, np.float64) for r in sample]))
    dims, n = directions.shape[1], reps.count()
    plane, centre = planes(dims, trees, seed), directions.mean(0)
    while n * trees > DIRECTORY * step:
        step *= 2

    placed = stash(by_key(rows.select("id", "key"), reps.select("key", "rep", "size"), "key", "size").select("id", "rep", "size"))
    members = placed.filter("size > 1").withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("_n") <= k + 1)
    members = members.groupBy("rep").agg(F.collect_list("id").alias("ids"))
    queries = placed.filter(asked).select(F.col("id").alias("qid"), F.col("rep").alias("qrep"))
    ask = queries.groupBy("qrep").agg(F.count("*").alias("asks"))

    blocks = forest(reps, plane, centre, step, block)
    ways = packs(ask.join(reps.select(F.col("rep").alias("qrep"), "v"), "qrep").select(F.col("qrep").alias("id"), "v"), plane, centre, Directory(blocks, trees), int(np.ceil(cost * n**growth)))
    found = search(blocks, ways, dims, k + 1).groupBy("qid", "id").agg(F.max("score").alias("score"))  # a row may be met in several trees
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("_n") <= k + 1)
    named = found.withColumnRenamed("id", "rep").join(members, "rep", "left").withColumn("ids", F.coalesce("ids", F.array("rep")))
    pairs = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id")))
    answers = named.select(F.col("qid").alias("qrep"), pairs.alias("p")).groupBy("qrep").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    answers = stash(answers.join(ask, "qrep"))
    others = F.slice(F.filter("p", lambda x: x["id"] != F.col("qid")), 1, k)
    each = by_key(queries, answers, "qrep", "asks").select("qid", F.posexplode(others).alias("rank", "x"))
    return each.select("qid", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), (-F.col("x.s")).alias("score"))


def op13_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(documents(spark, sf_dir, "embeddings"), "id % 50 = 0")
    return found.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")

"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and of pairs of neighbouring words in the training texts are quantised on a log scale: a count c has level
1 + floor(log(c) / log(BASE)). An n-gram of level q goes into the filter q times, as (n-gram, 1) .. (n-gram, q). To read a
count, (n-gram, 1), (n-gram, 2) .. are probed until one is absent; the level stands for the mean of its range. All probe
bits of one entry lie in one 64-bit word, so that a probe reads memory once. A text's probability is

    p(w | v) = WEIGHT * min(1, c(v w) / c(v)) + (1 - WEIGHT) * (c(w) + 1) / (N + V + 1)

over its words and one end, where the end also stands before the first word, and all c come from the filter.

Counting: the number of buckets follows from the bytes of the training texts, BUCKET_BYTES each or fewer, and so the filter and the
scores are the same on any partitioning and number of cores. Each task counts its n-grams and hands each bucket its hashes and counts as
two packed arrays; a bucket adds
them up and makes its own segment of the filter, of BITS bits an entry at every size. The segments are broadcast in parts
of MAX_FILTER bytes or so, by whole segments. With several parts a worker holds one at a time: for each FAR_BYTES of texts it loads the
parts one after the other and reads from each the n-grams whose buckets it has. The words' exact counts, which the base
score needs, are broadcast up to MAX_WORDS words; beyond that, texts' words join them by a shuffle.

Defined cases: a null text is the empty text and scores its one end; a null doc_id is never held out; with nothing to
train on the base is 0 and all words are unknown; rows with the same id are scored each; texts of any length are read whole,
and counts are 64-bit numbers; an empty table gives an empty result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, mix, spread, stash

BASE, WEIGHT, BITS, PROBES = 1.5, 0.6, 8, 3
MAX_FILTER, MAX_WORDS = 256 << 20, 8_000_000
END = b" "  # no word is equal to it
U = np.uint64
FLUSH = 3_000_000  # n-grams that a task holds before it hands them on
BUCKET_BYTES = 4 << 20  # of training texts for one bucket, or up to half of that
CHUNK = 100_000  # tokens that are scored at once
FAR_BYTES, FAR_CHUNK = 16 << 20, 4_000_000  # texts and tokens for which all parts of a filter of several are loaded once


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


#: What each level stands for; level 0 is absent.
MEANS = np.array([0.0] + [(np.ceil(BASE ** (q - 1) - 1e-9) + max(np.ceil(BASE**q - 1e-9) - 1, np.ceil(BASE ** (q - 1) - 1e-9))) / 2 for q in range(1, 110)])


def couple(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * U(0x9DDFEA08EB382D69) + h)


def pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of each word with the one before it; the end comes before the first."""
    return couple(np.concatenate([h[-1:], h[:-1]]), h)


def probe(h: np.ndarray, q: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place (in 1/2**32 of a segment, scaled to ``words``) and mask of the entries (h, q)."""
    e = mix(h + U(q * 0xA0761D6478BD642F & (1 << 64) - 1))
    mask = np.zeros(len(h), U)
    for i in range(PROBES):
        mask |= U(1) << (e >> U(6 * i) & U(63))
    return ((e >> U(32)) * words >> U(32)).astype(np.int64), mask


class Words(dict):
    """Places of words in a bounded table of their hashes, exact counts and counts by the filter."""

    LIMIT = 500_000

    def __init__(self, model: dict):
        self.model, self.todo, self.unread = model, [], np.empty(0, np.int64)
        self.hash = np.zeros(self.LIMIT + 1, U)
        self.exact, self.mean = np.zeros(self.LIMIT + 1, np.int64), np.zeros(self.LIMIT + 1)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.todo.append(word)
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) + len(words) > self.LIMIT:
            self.clear()
            if len(words) > self.LIMIT:
                self.hash = np.zeros(len(words) + 1, U)
                self.exact, self.mean = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1)
                self.LIMIT = len(words)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.todo:
            h = hashed(self.todo)
            new = np.arange(len(self) - len(self.todo), len(self))
            self.hash[new], self.unread = h, new
            if (known := self.model["words"]) is not None and len(known):
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                self.exact[new] = np.where(known[i] == h, self.model["counts"][i], 0)
            self.todo = []
        return at

    def counts(self, h: np.ndarray) -> np.ndarray:
        """The counts of n-grams by the filter; those of new words are read along with them."""
        n = len(self.unread)
        both = read(self.model, np.concatenate([self.hash[self.unread], h]))
        self.mean[self.unread], self.unread = both[:n], np.empty(0, np.int64)
        return both[n:]


def hashed(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U, len(words))


def read(model: dict, h: np.ndarray) -> np.ndarray:
    """The counts of n-grams as the filter has them. Of several parts none stays in memory."""
    q, parts = np.zeros(len(h), np.int64), model["parts"]
    for k, part in enumerate(parts):
        live, at = np.arange(len(h)), h
        if len(parts) > 1:
            live = np.flatnonzero(model["part"][(h >> U(40)) % U(model["buckets"])] == k)
            at = h[live]
        if not len(live):
            continue
        bits = part.value
        for j in range(1, len(MEANS)):
            b = (at >> U(40)) % U(model["buckets"])
            place, mask = probe(at, j, model["sizes"][b])
            there = (bits[model["firsts"][b] + place] & mask) == mask
            live, at = live[there], at[there]
            if not len(live):
                break
            q[live] = j
        if len(parts) > 1:
            del bits
            part.__dict__.pop("_value", None)  # the worker's copy; the next use loads it again from the executor's file
    return MEANS[q]


def filter_parts(spark: SparkSession, model: DataFrame, buckets: int) -> dict:
    """The filter of ``train`` in broadcast parts of MAX_FILTER bytes or so, and where each bucket's segment lies."""
    sizes, firsts, part = np.ones(buckets, np.int64), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    parts, held, size = [], [], 0
    cast = lambda: parts.append(spark.sparkContext.broadcast(np.concatenate(held or [np.zeros(1, U)])))
    for r in model.select("bucket", "bits", "size").toLocalIterator():  # a segment at a time
        if held and 8 * (size + r.size) > MAX_FILTER:
            cast()
            held, size = [], 0
        sizes[r.bucket], firsts[r.bucket], part[r.bucket] = r.size, size, len(parts)
        held.append(np.frombuffer(r.bits, U))
        size += r.size
    if held or not parts:
        cast()
    return {"parts": parts, "sizes": sizes.astype(U), "firsts": firsts, "part": part, "buckets": buckets}


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The batches put together, each of ``least`` bytes or more but for the last."""
    own: list[pa.RecordBatch] = []
    for b in batches:
        own.append(b)
        if sum(x.nbytes for x in own) >= least:
            yield pa.concat_batches(own)
            own = []
    if own:
        yield pa.concat_batches(own)


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def _packed(kind: int, h: np.ndarray, count: np.ndarray, buckets: int) -> pa.RecordBatch:
    b = ((h >> U(40)) % U(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    h, count, b = h[order], count[order].astype(np.uint32), b[order]
    there, first = np.unique(b, return_index=True)
    cut = list(zip(first, [*first[1:], len(b)], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(there.astype(np.int32)), pa.array(np.full(len(there), kind, np.int32)), pa.array([h[x:y].tobytes() for x, y in cut], pa.binary()), pa.array([count[x:y].tobytes() for x, y in cut], pa.binary())],
        names=["bucket", "kind", "h", "n"],
    )


def train(docs: DataFrame, text_col: str = "text", entry_bits: int = BITS) -> DataFrame:
    """A row for each bucket: words and their counts (sorted by hash), the bucket's segment of the filter, and its totals."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")).cast("long")).alias("n")).first().n or 0
    buckets = max(8, 1 << (size // BUCKET_BYTES).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ones: list[np.ndarray] = []
        twos: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, own in ((1, ones), (2, twos)):
                yield _packed(kind, *np.unique(np.concatenate(own), return_counts=True), buckets)
                own.clear()

        for b in batches:
            for x in b.column(0):
                words = tokens(x.as_py())
                if new := [w for w in set(words) if w not in known]:
                    if len(known) > 300_000:
                        known.clear()
                        new = list(set(words))
                    known.update(zip(new, hashed(new).tolist(), strict=True))
                h = np.fromiter(map(known.__getitem__, words), U, len(words))
                ones.append(h)
                twos.append(pairs(h))
                size += len(h)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def add_up(table: pa.Table) -> pa.Table:
        out = {}
        for kind in (1, 2):
            own = table.filter(pa.compute.equal(table["kind"], kind))
            h = np.frombuffer(b"".join(own["h"].to_pylist()), U)
            n = np.frombuffer(b"".join(own["n"].to_pylist()), np.uint32)
            sums, at = np.unique(h, return_inverse=True)
            out[kind] = sums, np.bincount(at, weights=n, minlength=len(sums)).astype(np.int64)
        both = [(h, level(n)) for h, n in out.values()]
        entries = int(sum(q.sum() for _, q in both))
        size = max(1, -(-entries * entry_bits // 64))
        bits = np.zeros(size, U)
        for h, q in both:
            for j in range(1, int(q.max(initial=0)) + 1):
                place, mask = probe(h[q >= j], j, np.full((q >= j).sum(), size, U))
                np.bitwise_or.at(bits, place, mask)
        h, n = out[1]
        row = {"bucket": table["bucket"][0].as_py(), "h": h.tobytes(), "n": n.tobytes(), "words": len(h), "tokens": int(n.sum()), "bits": bits.tobytes(), "size": size}
        return pa.Table.from_pylist([row], schema=pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("n", pa.binary()), ("words", pa.int64()), ("tokens", pa.int64()), ("bits", pa.binary()), ("size", pa.int64())]))

    packed = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "bucket int, kind int, h binary, n binary")
    return packed.groupBy("bucket").applyInArrow(add_up, "bucket int, h binary, n binary, words long, tokens long, bits binary, size long").withColumn("buckets", F.lit(buckets))


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, entry_bits: int = BITS) -> DataFrame:
    """One row per document: id, held_out (false), n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    model = stash(train(training, text_col, entry_bits))
    total = model.agg(F.sum("words").alias("v"), F.sum("tokens").alias("n"), F.max("buckets").alias("b")).first()
    n, v, buckets = total.n or 0, total.v or 0, total.b or 1
    held = filter_parts(spark, model, buckets) | {"words": None, "counts": None}
    far = len(held["parts"]) > 1
    chunk = FAR_CHUNK if far else CHUNK
    filled = (lambda batches: gathered(batches, FAR_BYTES)) if far else iter
    near = v <= max_words
    if near:
        own = [(np.frombuffer(r.h, U), np.frombuffer(r.n, np.int64)) for r in model.select("h", "n").toLocalIterator()]
        h = np.concatenate([x for x, _ in own] or [np.empty(0, U)])
        order = np.argsort(h)
        held["words"], held["counts"] = h[order], np.concatenate([x for _, x in own] or [np.empty(0, np.int64)])[order]
        if held["counts"].max(initial=0) < 1 << 32:
            held["counts"] = held["counts"].astype(np.uint32)  # no count is cut
        del own, h, order
    parts = held.pop("parts")
    cast = spark.sparkContext.broadcast(held)
    del held
    lowest, spare = np.log10(n + v + 1), 1.0 / (n + v + 1)

    def chunks(words: Words, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For ``chunk`` tokens or so at once: the places of all tokens, where each text begins, and each text's score."""
        flat, firsts = [], []
        for i, x in enumerate(texts):
            firsts.append(len(flat))
            flat += tokens(x.as_py())
            if len(flat) >= chunk or i == len(texts) - 1:
                at, first = words.of(flat), np.array(firsts)
                before = np.concatenate([at[-1:], at[:-1]])
                before[first] = at[-1]  # each text's last token is the end, and so it is before its first
                both = words.counts(couple(words.hash[before], words.hash[at]))
                p = WEIGHT * np.minimum(1.0, both / np.maximum(words.mean[before], 1.0)) + (1 - WEIGHT) * np.minimum(1.0, (words.mean[at] + 1) * spare)
                yield at, first, np.add.reduceat(np.log10(p), first)
                flat, firsts = [], []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(cast.value | {"parts": parts})
        for b in filled(batches):
            n, known, base, own = [], [], [], []
            for at, first, p in chunks(words, b.column(1)):
                c = words.exact[at]
                size = np.diff([*first, len(at)])
                n.append(size)
                known.append(np.add.reduceat((c > 0).astype(np.int64), first))
                base.append(np.add.reduceat(np.log10(c + 1.0), first) - size * lowest)
                own.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate(x) if x else [], t) for x, t in ((n, pa.int64()), (known, pa.int64()), (base, pa.float64()), (own, pa.float64())))], names=list("abcde"))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(cast.value | {"parts": parts})
        for b in filled(batches):
            n_tokens, h, count, own = [], [], [], []
            for at, first, p in chunks(words, b.column(1)):
                for part in np.split(at, first[1:]):
                    u, c = np.unique(words.hash[part].view(np.int64), return_counts=True)
                    n_tokens.append(len(part))
                    h.append(u)
                    count.append(c)
                own += p.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_tokens, pa.int64()), pa.array(own, pa.float64()), pa.array(h, pa.list_(pa.int64())), pa.array(count, pa.list_(pa.int64()))], names=list("abcde"))

    kind = docs.schema[id_col].dataType.simpleString()
    read_docs = docs.select(F.col(id_col), F.col(text_col).cast("binary"))
    if near:
        out = read_docs.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double")
    else:
        out = far_base(stash(read_docs.mapInArrow(apart, f"`{id_col}` {kind}, n_tokens long, score double, h array<long>, c array<long>").withColumn("_row", F.monotonically_increasing_id())), model, id_col, lowest)
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def far_base(rows: DataFrame, model: DataFrame, id_col: str, lowest: float) -> DataFrame:
    """The base score by a join of the texts' words with the words' counts."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, n in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h.as_py(), np.int64)), pa.array(np.frombuffer(n.as_py(), np.int64))], names=["h", "n"])

    counts = model.select("h", "n").mapInArrow(unpack, "_h long, _n long")
    each = rows.select("_row", F.explode(F.arrays_zip("h", "c")).alias("x")).select("_row", F.col("x.h").alias("_h"), F.col("x.c").alias("_c"))
    sums = each.join(counts, "_h").groupBy("_row").agg(F.sum("_c").alias("n_known"), F.sum(F.col("_c") * F.log10(F.col("_n") + 1.0)).alias("_s"))
    out = rows.select(id_col, "_row", "n_tokens", "score").join(sums, "_row", "left")
    return out.select(id_col, "n_tokens", F.coalesce("n_known", F.lit(0)).alias("n_known"), (F.coalesce("_s", F.lit(0.0)) - F.col("n_tokens") * float(lowest)).alias("base_score"), "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    out = score(docs, docs.filter(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

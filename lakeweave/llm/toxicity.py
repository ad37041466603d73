"""Toxicity by cumulative-link ordinal regression on sparse features of the words.

A word's features are the runs of GRAM bytes in it (its two ends marked), hashed to BITS bits: runs with the same hash are one feature, so
that there are 2**BITS features at most, and none is dropped for another. The model keeps those that
a share LEAST of the sample's toxic documents, and 2 documents, have at least and whose odds differ between toxic and other documents by exp(ODDS) or more. A document's features count its distinct words that have them. With one weight vector w and ordered thresholds t_1 < .. < t_K,
P(grade >= k) = 1 / (1 + exp(t_k - w.x)); the expected severity is the sum of these over k.

Labels tell toxic from other documents; grades 1 to K part the toxic ones of the sample by how many of their distinct
words have a kept run that no other document of the sample has, at the quantiles of that number. The model is fitted on a
sample of SAMPLE labelled documents of either kind, chosen by a hash of their ids; scoring reads all documents whole. The
runs of the sample are counted in the tasks; the driver gathers the kept ones, and of each document of the sample its
counts of these, as packed arrays.

Because the score is linear, a word adds the same wherever it stands: workers keep a bounded table of words' scores.

Defined cases: a null text is the empty text; without words a document has its score from the thresholds alone; with
no toxic or no other labelled document nothing is toxic and severity is 0; a document that is labelled both ways is in both
samples; of rows that share an id the one with the least text is in the sample, and each is scored; texts of any length are read whole; an empty table gives an empty result; other columns are left out,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, spread, stash

GRAM, SAMPLE, GRADES = 4, 2_000, 3
BITS, LEAST, ODDS = 20, 0.01, 2.5
FLUSH = 2_000_000  # runs that a task counts before it hands them on
ROUNDS, RATE, RIDGE, PRIOR = 1_000, 0.5, 1e-4, 0.5


def places(word: bytes) -> list[int]:
    w = b"\x02" + word + b"\x03"
    return sorted({xxhash.xxh32_intdigest(w[i : i + GRAM]) >> (32 - BITS) for i in range(max(1, len(w) - GRAM + 1))})


def distinct_words(text: bytes | None) -> set[bytes]:
    return set((text or b"").lower().split())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Known features, their weights and the thresholds."""

    def __init__(self, features: np.ndarray, w: np.ndarray, t: np.ndarray):
        self.features, self.w, self.t = features, w, t
        self.weight = dict(zip(features.tolist(), w.tolist(), strict=True))


def fit(features: np.ndarray, toxic: np.ndarray, marked: np.ndarray, rows: np.ndarray, at: np.ndarray, count: np.ndarray, prior: float = PRIOR) -> Model:
    """Weights and thresholds by Adagrad on the whole sample.

    ``toxic`` and ``marked`` (how many words are telling) are of its documents; document ``rows[i]`` has ``count[i]`` distinct words with ``features[at[i]]``.
    """
    grade = grades(marked, toxic)
    top, size, n = int(grade.max()), len(toxic), np.log1p(count.astype(float))
    above = (grade[:, None] >= np.arange(1, top + 1)).astype(float)
    share = above.mean(0).clip(1e-6, 1 - 1e-6)
    w, t = np.zeros(len(features)), np.log((1 - share) / share)
    gw, gt = np.full(len(w), 1e-8), np.full(top, 1e-8)
    for _ in range(ROUNDS):
        x = np.bincount(rows, n * w[at], size)
        left = (_sigmoid(x[:, None] - t) - above) / size
        dw, dt = np.bincount(at, n * left.sum(1)[rows], len(w)) + RIDGE * w, -left.sum(0)
        gw += dw * dw
        gt += dt * dt
        w -= RATE * dw / np.sqrt(gw)
        t = np.sort(t - RATE * dt / np.sqrt(gt))
    own = toxic.mean()  # the thresholds are moved from the sample's share of toxic documents to the prior
    t = t + np.log((1 - prior) / prior) - np.log((1 - own) / own)
    return Model(features, w, t)


def grades(marked: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for other documents; 1 to GRADES for toxic ones, by how many telling words they have."""
    cuts = np.quantile(marked[toxic == 1], [k / GRADES for k in range(1, GRADES)])
    return np.where(toxic == 1, 1 + (marked[:, None] > cuts).sum(1), 0)


class Places(dict):
    """The places of words, remembered up to a bound; of those in ``only`` if it is given."""

    LIMIT = 200_000

    def __init__(self, only: set[int] | None = None):
        self.only = only

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = own = [i for i in places(word) if self.only is None or i in self.only]
        return own


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(_toxic, _text) of the sample."""
    order = F.xxhash64(F.lit("sample"), F.col(id_col)), F.col(id_col)
    kinds = [labels.filter(F.col(label_col) == k).select(id_col, F.lit(k).alias("_toxic")).dropDuplicates([id_col]).orderBy(*order).limit(SAMPLE) for k in (0, 1)]
    chosen = F.broadcast(kinds[0].unionByName(kinds[1]))  # 2 * SAMPLE rows
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text")).join(chosen, id_col)
    return rows.groupBy(id_col, "_toxic").agg(F.min("_text").alias("_text")).select("_toxic", "_text")


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model | None:
    sample = stash(sampled(docs, labels, id_col, text_col, label_col))
    of = {r["_toxic"]: r["n"] for r in sample.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if set(of) != {0, 1}:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Places(), {0: [], 1: []}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for k, own in held.items():
                f, n = np.unique(np.concatenate(own or [np.empty(0, np.int64)]), return_counts=True)
                own.clear()
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n * k), pa.array(n)], names=["f", "bad", "n"])

        for b in batches:
            for kind, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.unique(np.fromiter((i for w in distinct_words(text.as_py()) for i in known[w]), np.int64))
                held[kind].append(own)
                size += len(own)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    counts = sample.mapInArrow(counted, "f long, bad long, n long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    part = lambda some, whole: F.log((some + 0.5) / (F.lit(whole) - some + 0.5))
    odds = part(F.col("bad"), of[1]) - part(F.col("n") - F.col("bad"), of[0])
    kept = counts.filter(F.col("n") >= max(2, LEAST * of[1])).select("f", odds.alias("odds"), (F.col("n") == F.col("bad")).alias("only")).filter(F.abs("odds") >= ODDS)
    kept = kept.orderBy("f").collect()
    features = np.array([r.f for r in kept], np.int64)
    telling = {r.f for r in kept if r.only}
    known_to_all = sample.sparkSession.sparkContext.broadcast((set(features.tolist()), telling))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, tells = known_to_all.value
        known = Places(only)
        for b in batches:
            marked, f, n = [], [], []
            for text in b.column(1):
                words = [known[w] for w in distinct_words(text.as_py())]
                own, count = np.unique(np.fromiter((i for w in words for i in w), np.int64), return_counts=True)
                marked.append(sum(not tells.isdisjoint(w) for w in words))
                f.append(own.astype(np.int32).tobytes())
                n.append(count.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marked, pa.int64()), pa.array(f, pa.binary()), pa.array(n, pa.binary())], names=["t", "m", "f", "n"])

    rows = sample.mapInArrow(read, "t int, m long, f binary, n binary").collect()
    rows.sort(key=lambda r: (r.t, r.m, bytes(r.f), bytes(r.n)))  # the same sums in any order of the tasks
    flat = lambda name: np.frombuffer(b"".join(bytes(r[name]) for r in rows), np.int32)
    toxic, marked = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    return fit(features, toxic, marked, np.repeat(np.arange(len(rows)), [len(r.f) // 4 for r in rows]), np.searchsorted(features, flat("f")), flat("n"))


def severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: id, severity (expected grade), grade (the likeliest), p_toxic, toxic (p_toxic of a half or more)."""
    docs = spread(docs)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value or Model(np.empty(0, np.uint32), np.empty(0), np.full(1, np.inf))
        t, known = m.t, Places(set(m.weight))
        for b in batches:
            x = np.zeros(b.num_rows)
            for i, text in enumerate(b.column(1)):
                flat: list[int] = []
                for word in distinct_words(text.as_py()):
                    flat += known[word]
                if flat:
                    at, n = np.unique(np.array(flat), return_counts=True)
                    x[i] = sum(np.log1p(c) * m.weight[f] for f, c in zip(at.tolist(), n.tolist(), strict=True))
            above = _sigmoid(x[:, None] - t)
            exact = np.concatenate([np.ones((len(x), 1)), above], 1) - np.concatenate([above, np.zeros((len(x), 1))], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(np.isinf(t[0]), 0.0, above.sum(1))), pa.array(exact.argmax(1).astype(np.int32)), pa.array(above[:, 0] * (not np.isinf(t[0])))], names=list("abcd"))

    out = docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` {kind}, severity double, grade int, p_toxic double")
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))

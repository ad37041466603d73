"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of neighbouring words (ASCII lower case) are hashed to BUCKETS buckets. Counts over all documents give
the raw multinomial, counts over the trusted ones (labelled quality 1) the target; both are smoothed by SMOOTHING a
bucket. A document's score is the mean over its n-grams of ln(target / raw). Documents that score under the threshold
are rejected, and so is every document that fails the base rules. The verdict is the same for the same text and model.

The threshold lies STEPS standard deviations of the trusted documents' scores under their mean score, where mean and
deviation are over all trusted documents, each score shrunk towards 0 as if it had SHRINK more n-grams.

Defined cases: a null text has no words; the empty text, or one of white space alone, has n_words 0 and fails the base
rules; where no document is trusted all ratios are 0 and only the base rules decide; a score equal to the threshold is kept;
repeated rows are counted and judged each; an id that is trusted is so in all rows that have it, a null id never; texts of any
length are read whole; an empty table gives an empty result; extra columns are left out, whatever their names (``accepted``
passes all columns on).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WordHashes, documents, small, spread, windows

BUCKETS, SMOOTHING, SHRINK, STEPS = 1 << 15, 1.0, 50, 6.0
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"  # fixed values
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))


def buckets(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    h = hashes.of([w.lower() for w in words])
    return np.concatenate([windows(h, 1), windows(h, 2)]) % np.uint64(BUCKETS)


def repeated(words: list[bytes], hashes: WordHashes) -> int:
    """Words that lie in a window of WINDOW words which the text has twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = windows(hashes.of(words), WINDOW)
    _, at, count = np.unique(h, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[at] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def base_counts(text: bytes, words: list[bytes], hashes: WordHashes) -> tuple[int, int, int, int, int]:
    lines = Counter(x for x in text.split(b"\n") if x and not x.isspace())
    return (
        len(words), len(b"".join(words).translate(None, _CONTINUED)), len(text.translate(None, _NOT_SYMBOLS)),
        sum(lines.values()) - len(lines), repeated(words, hashes),
    )


def fit(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """ln(target / raw) for each bucket. Counts are summed in the tasks, then over BUCKETS groups at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, raw, target = WordHashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text, good in zip(b.column(0), b.column(1), strict=True):
                n = np.bincount(buckets((text.as_py() or b"").split(), hashes).astype(np.int64), minlength=BUCKETS)
                raw += n
                if good.as_py():
                    target += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], names=["b", "r", "t"])

    marked = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"))
    good = trusted.select(id_col).distinct().withColumn("_good", F.lit(True))
    marked = marked.join(small(good), id_col, "left").select("_text", "_good")
    rows = marked.mapInArrow(run, "b long, r long, t long").groupBy("b").agg(F.sum("r").alias("r"), F.sum("t").alias("t")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["b"]], target[rows["b"]] = rows["r"], rows["t"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS))


def judged(text: bytes | None, hashes: WordHashes, ratios: np.ndarray) -> tuple[int, int, int, int, int, float]:
    """The base counts and the score of a text."""
    text = text or b""
    words = text.split()
    own = ratios[buckets(words, hashes)]
    return *base_counts(text, words, hashes), float(own.sum() / (len(own) + SHRINK))


def failed(row: tuple) -> bool:
    return row[0] < MIN_WORDS or 100 * row[4] > MAX_REPEAT_PERCENT * row[0]


def scored(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base counts, base_failed and the score of each document."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ratio = WordHashes(), model.value
        for b in batches:
            rows = [judged(x.as_py(), hashes, ratio) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5)), pa.array([r[5] for r in rows], pa.float64())], names=list("abcdefg"))

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def threshold(docs: DataFrame, trusted: DataFrame, ratios: np.ndarray, id_col: str, text_col: str) -> float:
    """The score under which documents are rejected. Only trusted documents are read."""
    good = docs.select(id_col, text_col).join(small(trusted.select(id_col).distinct()), id_col, "left_semi")
    least = scored(good, ratios, id_col, text_col).filter("not base_failed").agg(F.avg("score") - STEPS * F.stddev_pop("score")).first()[0]
    return float("-inf") if least is None else least


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``scored`` and ``kept``. ``trusted`` has the ids of the trusted documents."""
    docs = spread(docs)
    ratios = fit(docs, trusted, id_col, text_col)
    least = threshold(docs, trusted, ratios, id_col, text_col)
    return scored(docs, ratios, id_col, text_col).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))


def accepted(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns and without a shuffle."""
    docs = spread(docs)
    ratios = fit(docs, trusted, id_col, text_col)
    least = threshold(docs, trusted, ratios, id_col, text_col)
    model, at = docs.sparkSession.sparkContext.broadcast(ratios), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            keep = [not failed(row) and row[5] >= least for row in (judged(x.as_py(), hashes, model.value) for x in b.column(at).cast(pa.binary()))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = documents(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    out = quality(documents(spark, sf_dir), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.sources.shipping import ship

#: One word: a run of anything but ASCII white space. ``bytes.split()`` finds the same words.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a folder of this machine in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lakeweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and no executor owns the copy."""
    spark = ship(df.sparkSession)
    path = f"{shared_dir(spark)}/lakeweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    if stack := _SCRATCH.get():
        stack[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakeweave_path = path
    return out


#: The lists of the blocks that are open, in this thread or task alone: queries in two threads leave each other's tables be.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes, at its end, what was stashed within it, but for the stashed tables given to the yielded function."""
    own: list[str] = []
    kept: list[str] = []
    outer = _SCRATCH.get()
    _SCRATCH.set((*outer, own))

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._lakeweave_path)
        return df

    try:
        yield keep
    finally:
        _SCRATCH.set(outer)
        for path in own:
            if path not in kept:
                _remove(SparkSession.active(), path)
        if outer:
            outer[-1].extend(kept)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def spread(df: DataFrame) -> DataFrame:
    """At least one input partition for each core where a small table has fewer."""
    n = ship(df.sparkSession).sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def small(df: DataFrame, most: int = 24 << 20) -> DataFrame:
    """``df``, marked for broadcast if it has so few bytes; else it stays as it is and joins by a shuffle.

    The size is what the files of a stashed table have (for some of its columns their share), so that no job is run to know it.
    """
    return df.hint("broadcast") if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most else df


def by_key(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int = 1_000) -> DataFrame:
    """``rows`` joined with the stashed ``groups`` of one row a key. Keys of over ``most`` rows go by a broadcast, so that no task gets a hot one.

    There are at most one such key in ``most`` rows; where they too have many bytes the join of theirs is a shuffle.
    """
    hot = small(stash(groups.filter(F.col(size) > most)))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(groups.filter(F.col(size) <= most), key))


def repeated_ids(df: DataFrame, id_col: str) -> bool:
    """Whether an id is null or stands in two rows."""
    seen = df.groupBy(F.col(id_col).alias("i")).agg(F.count("*").alias("n"))
    return bool(seen.filter("n > 1 or i is null").limit(1).count())


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many _ after it as ``df`` needs to have no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads sums and products over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` neighbours of ``h``, in order."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : i + m]
    return mix(out)

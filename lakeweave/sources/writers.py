"""Sinks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's folder for checkpoints. Where none is set, one of this machine's own in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lakeweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


def own_folder(spark: SparkSession, what: str = "") -> str:
    """The name of a new folder in the shared one; what is written there goes when the interpreter ends."""
    path = f"{checkpoint_dir(spark)}/lakeweave-{what}{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def write_vectors(df: DataFrame, path: str, by: list[str]) -> None:
    """Vector records as Parquet, partitioned (say by model and split); an existing target is an error."""
    df.repartition(*by).write.mode("errorifexists").partitionBy(*by).parquet(path)


def write_table(df: DataFrame, path: str, order: list[str], single: bool = False) -> None:
    """CSV with a header. ``single`` is for reports that fit one file."""
    out = df.orderBy(*order)
    (out.coalesce(1) if single else out).write.mode("errorifexists").option("header", True).csv(path)


def write_sketches(df: DataFrame, path: str) -> None:
    """One JSON record per table, compressed."""
    df.write.mode("errorifexists").json(path, compression="bzip2")


def merge_shards(shards: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key by ``order``; keys are summed up before the shuffle."""
    rest = [c for c in shards.columns if c != key]
    last = shards.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return last.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def flatten(df: DataFrame) -> DataFrame:
    """One level of structs: a.b becomes a_b."""
    out = []
    for f in df.schema:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"`{f.name}`.`{c}`").alias(f"{f.name}_{c}") for c in f.dataType.names]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def shards_of(df: DataFrame, name: str, n: int) -> DataFrame:
    """Sorted names dealt to n shards of nearly equal size, the first ones larger; equal names share one."""
    from lakeweave.operators import ranks  # it needs this module's folder

    few, larger = divmod(df.count(), n)
    at, wide = F.col("_at"), larger * (few + 1)
    shard = F.when(at < wide, F.floor(at / (few + 1))).otherwise(larger + F.floor((at - wide) / max(few, 1))) + 1
    return ranks.numbered(df, name, "_at").withColumn("shard", shard.cast("long")).drop("_at")

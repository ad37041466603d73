"""Data sets in their folders: a manifest with splits, train and test files, or one file; vectors with labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import read_csv


@dataclass
class Dataset:
    frame: DataFrame  # all rows, with row_idx
    splits: DataFrame  # (split, row_idx); a row may be in several
    labels: list[str]

    def split(self, name: str, features_only: bool = False) -> DataFrame:
        rows = self.splits.filter(F.col("split") == name).select("row_idx")
        out = self.frame.join(rows, "row_idx")
        return out.drop(*self.labels) if features_only else out

    def task(self, label: str) -> str:
        return "regression" if dict(self.frame.dtypes)[label] in ("double", "float") else "classification"


def _numbered(df: DataFrame) -> DataFrame:
    """Row numbers in the order of the files' parts: a number per partition's start, then within the partition."""
    marked = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sizes = marked.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    number = F.col("_at") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(starts, "_p").withColumn("row_idx", number.cast("long")).drop("_p", "_i", "_at")


def names_in(spark: SparkSession, path: str) -> set[str]:
    """What lies in a folder of any store, without reading it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return {f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)}


def load(spark: SparkSession, path: str, labels: list[str]) -> Dataset:
    """By what the folder has: data.csv with splits.json (split, row_idx); train.csv and test.csv; or data.csv alone. Each is a file or a folder of parts."""
    names = names_in(spark, path)
    if {"train.csv", "test.csv"} <= names:
        parts = [read_csv(spark, f"{path}/{s}.csv").withColumn("_split", F.lit(s)) for s in ("train", "test")]
        frame = _numbered(parts[0].unionByName(parts[1]))
        return Dataset(frame.drop("_split"), frame.select(F.col("_split").alias("split"), "row_idx"), labels)
    frame = _numbered(read_csv(spark, f"{path}/data.csv"))
    if "splits.json" in names:
        return Dataset(frame, spark.read.schema("split string, row_idx long").json(f"{path}/splits.json"), labels)
    return Dataset(frame, frame.select(F.lit("all").alias("split"), "row_idx"), labels)


def with_vectors(labels: DataFrame, vectors: DataFrame, dim: int, classes: list[str]) -> DataFrame:
    """Labels (table_id, col_idx, class) with vectors (table_id, col_idx, v): a missing vector is zeros with mask 0; classes one-hot."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    named = labels.withColumn("table_id", table_name(F.col("table_id")))
    out = named.join(vectors, ["table_id", "col_idx"], "left").withColumn("mask", F.col("v").isNotNull().cast("int"))
    hot = F.array(*[(F.col("class") == c).cast("int") for c in classes])
    return out.withColumn("v", F.coalesce("v", zero)).withColumn("one_hot", hot)


def table_name(c: Column) -> Column:
    """Ids that are numbers get the prefix table_."""
    return F.when(c.cast("string").rlike("^[0-9]+$"), F.concat(F.lit("table_"), c.cast("string"))).otherwise(c.cast("string"))


def natural_columns(keys: Column) -> Column:
    """Numeric names by number, then the others by name."""
    digits = F.filter(keys, lambda k: k.rlike("^[0-9]+$"))
    rest = F.filter(keys, lambda k: ~k.rlike("^[0-9]+$"))
    by_number = F.transform(F.array_sort(F.transform(digits, lambda k: F.struct(k.cast("long").alias("n"), k.alias("k")))), lambda x: x["k"])
    return F.concat(by_number, F.array_sort(rest))


def sniff_encoding(spark: SparkSession, path: str, size: int = 65_536) -> str:
    """utf-8, utf-16 or latin-1, from a file's first bytes."""
    head = bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size).alias("c")).first().c)
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 4:
            return "latin-1"
    return "utf-8"

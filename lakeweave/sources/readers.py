"""Sources: delimited and JSON tables, lakes of them, vector records, labels and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.operators import ranks

#: The fixed layout of a vector record.
VECTOR_SCHEMA = T.StructType([
    T.StructField("table_id", T.StringType()), T.StructField("model_name", T.StringType()), T.StructField("embedding_dim", T.IntegerType()),
    T.StructField("column_embeddings", T.MapType(T.IntegerType(), T.ArrayType(T.FloatType()))),
    T.StructField("table_embedding", T.StructType([T.StructField(n, T.ArrayType(T.FloatType())) for n in ("cls_embedding", "table_embedding", "column_mean", "token_mean")])),
    T.StructField("context_embedding", T.ArrayType(T.FloatType())), T.StructField("column_names", T.ArrayType(T.StringType())), T.StructField("source_path", T.StringType()), T.StructField("version", T.StringType()),
])
MANIFEST_SCHEMA = "table_id string, parent_id string, split string, role string, fragment_type string, noise_tier int, replicate_id int, csv_path string, n_rows long, n_cols long, key_col_fragment string, key_col_parent string"
QUERY_SCHEMA = "query_table_id string, parent_id string, split string, noise_tier int, replicate_id int, relevant array<struct<table_id: string, relation: string>>"
#: Digits with an exponent of three places or more overflow a double: such columns stay text.
OVERFLOW = r"^[+-]?[0-9]*\.?[0-9]+[eE][+-]?[0-9]{3,}$"


def read_csv(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    """A delimited table with a header; malformed rows go; columns named Unnamed: n go; .gz and .bz2 are read as they are.

    ``text`` reads all as strings and keeps NA a text. Otherwise types are inferred, but for columns with ids that look
    like overflowing numbers, which stay text.
    """
    base = spark.read.option("header", True).option("mode", "DROPMALFORMED")
    raw = base.option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    keep = [c for c in raw.columns if not c.startswith("Unnamed: ")]
    if text:
        return raw.select(*[f"`{c}`" for c in keep])
    big = raw.agg(*[F.max(F.col(f"`{c}`").rlike(OVERFLOW)).alias(c) for c in raw.columns]).first()
    typed = base.option("inferSchema", True).csv(path)
    schema = T.StructType([T.StructField(f.name, T.StringType() if big[f.name] else f.dataType) for f in typed.schema])
    return base.schema(schema).csv(path).select(*[f"`{c}`" for c in keep])


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTOR_SCHEMA).parquet(path)


def read_vector_json(spark: SparkSession, path: str) -> DataFrame:
    """Vector records as JSON lines, whose map keys are text."""
    text = T.StructType([T.StructField(f.name, T.MapType(T.StringType(), f.dataType.valueType) if f.name == "column_embeddings" else f.dataType) for f in VECTOR_SCHEMA])
    return spark.read.schema(text).json(path).withColumn("column_embeddings", F.transform_keys("column_embeddings", lambda k, v: k.cast("int")))


def columns_of(vectors: DataFrame) -> DataFrame:
    """(table_id, col_idx, name, v): a name from the record, else the index as text; the last of equal names wins."""
    c = vectors.select("table_id", "column_names", F.explode("column_embeddings").alias("col_idx", "v"))
    c = c.withColumn("name", F.coalesce(F.translate(F.get("column_names", F.col("col_idx")), "\r\n", ""), F.col("col_idx").cast("string")))
    return c.groupBy("table_id", "name").agg(F.max_by(F.struct("col_idx", "v"), "col_idx").alias("x")).select("table_id", "x.col_idx", "name", "x.v")


def table_vector(vectors: DataFrame, variant: str) -> DataFrame:
    """The asked variant exactly; records that lack it go."""
    return vectors.select("table_id", F.col(f"table_embedding.{variant}").alias("v")).filter(F.col("v").isNotNull())


def valid_examples(tables: DataFrame, header: str = "header", most: int = 10) -> DataFrame:
    """Tables, as read from JSON lines, each of whose columns (name, name_tokens) has a token and a name of ``most`` words at most."""
    bad = lambda c: (F.size(F.split(c["name"], " ")) > most) | (F.size(F.coalesce(c["name_tokens"], F.array())) < 1)
    return tables.filter(~F.exists(header, bad))


def read_labels(spark: SparkSession, path: str, least: float | None = None) -> DataFrame:
    """Ground truth from CSV; with ``least`` only rows of that score or more, best first."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df if least is None else df.filter(F.col("score") >= least).orderBy(F.col("score").desc())


def read_allow_list(spark: SparkSession, path: str) -> DataFrame:
    """Names, one a line; blank lines and lines with # go."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> '' and not startswith(name, '#')")


def resolve_tables(names: DataFrame, name: str, places: list[DataFrame]) -> DataFrame:
    """(name, path): the path in the first of ``places`` (name, path) that has the name, else null."""
    out = names.select(name)
    for i, p in enumerate(places):
        out = out.join(p.select(F.col("name").alias(name), F.col("path").alias(f"_{i}")), name, "left")
    return out.select(name, F.coalesce(*[F.col(f"_{i}") for i in range(len(places))]).alias("path"))


def pairs_to_tables(pairs: DataFrame) -> DataFrame:
    """(table_id, csv) of pair rows, each table once; one name with two contents is an error."""
    both = pairs.select(F.explode(F.array(*[F.struct(F.col(f"table_{s}_id").alias("table_id"), F.col(f"table_{s}_csv").alias("csv")) for s in "ab"])).alias("x")).select("x.*")
    one = both.groupBy("table_id").agg(F.max("csv").alias("csv"), F.countDistinct(F.md5(F.col("csv").cast("binary"))).alias("n"))
    clash = one.filter("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"two contents for table {clash[0].table_id}")
    return one.drop("n")


def records_to_table(records: DataFrame, json_col: str, order: str) -> DataFrame:
    """JSON records to a wide table of strings; columns in the order in which keys first occur."""
    m = records.withColumn("_m", F.from_json(json_col, "map<string,string>"))
    keys = m.select(order, F.posexplode(F.map_keys("_m")).alias("p", "k")).groupBy("k").agg(F.min(F.struct(order, "p")).alias("at")).orderBy("at")
    names = [r.k for r in keys.select("k").collect()]  # a table's header
    return m.select(order, *[F.col("_m")[k].alias(k) for k in names])


def dedup_records(records: DataFrame, json_col: str, order: str) -> DataFrame:
    """(row_idx, record): each content once, numbered by first occurrence. Keys are sorted to compare contents."""
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(json_col, "map<string,string>")))))
    first = records.select(canonical.alias("record"), order).groupBy("record").agg(F.min(order).alias("at"))
    return ranks.numbered(first, "at", "row_idx").select("row_idx", "record")


def route(feed: DataFrame, kind: str, schema: str) -> DataFrame:
    """One record type of a mixed feed (record_type, record_json)."""
    return feed.filter(F.col("record_type") == kind).select(F.from_json("record_json", schema).alias("r")).select("r.*")


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's content."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def catalog(root: str, task: str, split: str) -> str:
    """Where a task's split lies."""
    return f"{root}/{task}/{split}"


def from_legacy(records: list[dict]) -> str:
    """Old vector records (a list of dicts) as JSON lines of the present layout."""
    out = []
    for r in records:
        columns = r.get("column_embeddings") or r.get("columns") or {}
        out.append({"table_id": r.get("table_id") or r.get("table") or r.get("file"), "column_embeddings": {int(k): list(map(float, v)) for k, v in columns.items()}, "version": "2.0"})
    return "\n".join(json.dumps(x) for x in out)

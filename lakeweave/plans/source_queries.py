"""Sources and sinks: tables written to the shared folder and read back, and what is made of records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions import cleaning as C
from lakeweave.operators import generate as G
from lakeweave.sources import datasets as D
from lakeweave.sources import lake_files as LF
from lakeweave.sources import readers as R
from lakeweave.sources import writers as W

from .lake_queries import CELLS_SQL, cells
from .prepare_queries import md5_sql
from .registry import query
from .vector_queries import E_SQL


def folder(t) -> tuple:
    """The session and a new folder in its shared one."""
    spark = t("region").sparkSession
    return spark, W.own_folder(spark)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(t):
    spark, path = folder(t)
    W.write_table(t("customer").withColumn("Unnamed: 0", F.lit(1)), path, ["c_custkey"])
    return R.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def csv_as_text(t):
    spark, path = folder(t)
    W.write_table(t("customer").select("c_custkey", "c_name", "c_nationkey"), path, ["c_custkey"])
    return R.read_csv(spark, path, text=True)


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS row_idx FROM nation)
SELECT row_idx, 0::INT AS col_idx, 'n_nationkey' AS col, n_nationkey::VARCHAR AS value FROM n UNION ALL SELECT row_idx, 1, 'n_name', n_name FROM n UNION ALL SELECT row_idx, 2, 'n_regionkey', n_regionkey::VARCHAR FROM n""")
def lake_cells(t):
    """A lake of one file, cut to cells."""
    spark, path = folder(t)
    W.write_table(t("nation"), path, ["n_nationkey"], single=True)
    return LF.read_lake(spark, path).select("row_idx", "col_idx", "col", "value")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines_round_trip(t):
    spark, path = folder(t)
    W.write_sketches(t("conversations"), path)
    return R.read_json_lines(spark, path, t("conversations").schema)


def _records(t):
    """A vector record a label: its vectors by their id, and their mean."""
    e = t("embeddings")
    v = e.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct(F.col("vec_id").cast("int"), "embedding"))).alias("column_embeddings"), F.min_by("embedding", "vec_id").alias("first"))
    kinds = {f.name: f.dataType for f in R.VECTOR_SCHEMA}
    some = {
        "table_id": F.concat(F.lit("t"), "label"), "column_embeddings": F.col("column_embeddings"),
        "table_embedding": F.struct(*[(F.col("first") if n == "column_mean" else F.lit(None)).cast("array<float>").alias(n) for n in kinds["table_embedding"].fieldNames()]),
        "column_names": F.array(F.lit("zero\n"), F.lit("one"), F.lit("two")),
    }
    return v.select(*[some.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


@query(f"""WITH {E_SQL} SELECT 't' || label AS table_id, id::INT AS col_idx, CASE id WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE id::VARCHAR END AS name, list_transform(v, lambda x: round(x, 6) + 0.0) AS v FROM e""")
def vector_record_columns(t):
    spark, path = folder(t)
    _records(t).write.json(path)
    return R.columns_of(R.read_vector_json(spark, path)).select("table_id", "col_idx", "name", F.transform("v", lambda x: F.round(x.cast("double"), 6) + 0.0).alias("v"))


@query(f"WITH {E_SQL} SELECT 't' || label AS table_id, list_transform(arg_min(v, id), lambda x: round(x, 6) + 0.0) AS v FROM e GROUP BY label")
def table_vector_variant(t):
    spark, path = folder(t)
    W.write_vectors(_records(t).withColumn("part", F.lit("a")), path, ["part"])
    out = R.table_vector(R.read_vectors(spark, path), "column_mean")
    return out.select("table_id", F.transform("v", lambda x: F.round(x.cast("double"), 6) + 0.0).alias("v"))


@query("SELECT l_orderkey AS query, l_partkey AS candidate, l_quantity AS score FROM lineitem WHERE l_quantity >= 40")
def labels_from_score(t):
    spark, path = folder(t)
    W.write_table(t("lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("candidate"), F.col("l_quantity").alias("score")), path, ["query"])
    return R.read_labels(spark, path, 40.0).select(F.col("query").cast("long"), F.col("candidate").cast("long"), "score")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN (SELECT min(c_mktsegment) FROM customer)")
def allow_list(t):
    spark, path = folder(t)
    names = t("customer").agg(F.min("c_mktsegment").alias("name"))
    lines = names.select(F.explode(F.array(F.lit("# names"), F.lit(""), F.concat(F.lit("  "), "name", F.lit(" ")))).alias("value"))
    lines.coalesce(1).write.text(path)
    return t("customer").join(R.read_allow_list(spark, path), F.col("c_mktsegment") == F.col("name"), "left_semi").select("c_custkey")


@query("""WITH p AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
x AS (SELECT o_orderkey AS k FROM p WHERE n IS NOT NULL UNION SELECT n FROM p WHERE n IS NOT NULL) SELECT 'o' || k AS table_id, 'key,priority' || chr(10) || k || ',' || o_orderpriority AS csv FROM x JOIN orders ON o_orderkey = k""")
def pair_tables(t):
    """The tables of pairs, each once: a customer's order with the next one."""
    o = t("orders").select("o_custkey", "o_orderkey", F.concat(F.lit("key,priority\n"), "o_orderkey", F.lit(","), "o_orderpriority").alias("csv"))
    both = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "csv"))).alias("x")).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("x") - 2))).filter("size(x) > 1")
    side = lambda s, at: (F.concat(F.lit("o"), F.get("x", at)["o_orderkey"]).alias(f"table_{s}_id"), F.get("x", at)["csv"].alias(f"table_{s}_csv"))
    return R.pairs_to_tables(both.select(*side("a", F.col("i")), *side("b", F.col("i") + 1)))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def records_wide(t):
    return R.records_to_table(t("events").select("event_id", "props"), "props", "event_id")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_type IN (SELECT min(event_type) FROM events)")
def routed_records(t):
    kind = t("events").agg(F.min("event_type")).first()[0]
    record = F.concat(F.lit('{"event_id":'), "event_id", F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return R.route(t("events").select(F.col("event_type").alias("record_type"), record.alias("record_json")), kind, "event_id long, k long")


@query("""WITH c AS (SELECT c_custkey, c_nationkey % 3 AS k FROM customer) SELECT 'table_' || c_custkey AS table_id, (vec_id IS NOT NULL)::INT AS mask,
CASE WHEN vec_id IS NULL THEN 0.0 ELSE round(embedding[1]::DOUBLE, 6) END AS x, [(k = 0)::INT, (k = 1)::INT, (k = 2)::INT] AS one_hot FROM c LEFT JOIN embeddings ON vec_id = c_custkey""")
def vectors_with_labels(t):
    labels = t("customer").select(F.col("c_custkey").alias("table_id"), F.lit(0).alias("col_idx"), F.concat(F.lit("k"), F.col("c_nationkey") % 3).alias("class"))
    vectors = t("embeddings").select(F.concat(F.lit("table_"), "vec_id").alias("table_id"), F.lit(0).alias("col_idx"), F.col("embedding").alias("v"))
    out = D.with_vectors(labels, vectors, 64, ["k0", "k1", "k2"])
    return out.select("table_id", "mask", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("x"), "one_hot")


@query("""SELECT page_id, replace(replace(html, chr(13), ''), chr(10), '') AS name, lower(translate(html, '"''' || chr(13) || chr(10) || ',', '')) AS plain,
CASE WHEN contains(html, ',') OR contains(html, '"') OR contains(html, chr(10)) OR contains(html, chr(13)) THEN '"' || replace(html, '"', '""') || '"' ELSE html END AS csv, lower(trim(url)) AS key FROM pages""")
def names_and_escapes(t):
    h = F.col("html")
    return t("pages").select("page_id", C.column_name(h).alias("name"), C.plain_name(h).alias("plain"), C.csv_escape(h).alias("csv"), C.normalize_key(F.col("url")).alias("key"))


@query("SELECT p_partkey, p_name || chr(10) || '|' || p_brand || chr(92) AS text FROM part")
def tsv_unescaped(t):
    escaped = F.concat("p_name", F.lit("\\n\\p"), "p_brand", F.lit("\\\\"))
    return t("part").select("p_partkey", C.tsv_unescape(escaped).alias("text"))


@query("SELECT o_custkey, coalesce('customer/' || c_custkey, 'part/' || p_partkey) AS path FROM (SELECT DISTINCT o_custkey + 1000 AS o_custkey FROM orders) LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = o_custkey")
def resolved_tables(t):
    """The first of two places that has a name."""
    names = t("orders").select((F.col("o_custkey") + 1000).alias("o_custkey")).distinct()
    places = [t("customer").select(F.col("c_custkey").alias("name"), F.concat(F.lit("customer/"), "c_custkey").alias("path")), t("part").select(F.col("p_partkey").alias("name"), F.concat(F.lit("part/"), "p_partkey").alias("path"))]
    return R.resolve_tables(names, "o_custkey", places)


def _roll(kind, *cols):
    return f"{md5_sql(f'aug:{kind}', *cols)} % 100"


_X, _COL, _ROW = _roll("x", "table_id", "row_idx", "col"), _roll("c", "table_id", "col"), _roll("r", "table_id", "row_idx")
_NUMBER = "try_cast(value AS DOUBLE) IS NOT NULL"
for _how, _sql in {
    "drop_col": f"SELECT table_id, row_idx, col, value FROM cells WHERE {_COL} >= 20",
    "sample_row": f"SELECT table_id, row_idx, col, value FROM cells WHERE {_ROW} >= 20",
    "drop_cell": f"SELECT table_id, row_idx, col, CASE WHEN {_X} >= 20 THEN value END AS value FROM cells",
    "drop_num_cell": f"SELECT table_id, row_idx, col, CASE WHEN NOT ({_NUMBER} AND {_X} < 20) THEN value END AS value FROM cells",
    "drop_num_col": f"SELECT table_id, row_idx, col, value FROM cells WINDOW w AS (PARTITION BY table_id, col) QUALIFY count(*) FILTER ({_NUMBER}) OVER w < count(value) OVER w OR count(value) OVER w = 0",
    "drop_nan_col": "SELECT table_id, row_idx, col, value FROM cells QUALIFY count(value) OVER (PARTITION BY table_id, col) > 0",
}.items():

    def _augmented(t, how=_how):
        return G.augment(cells(t).select("table_id", "row_idx", "col", "value"), how)

    query(f"WITH {CELLS_SQL} {_sql}", name=f"augment_{_how}")(_augmented)


@query("""WITH b AS (SELECT count(*) AS n FROM part), v AS (SELECT DISTINCT p_size AS v FROM part), i AS (SELECT 'rows_' || v AS id FROM v UNION ALL SELECT 'wide_features_' || (2 * v) FROM v)
SELECT id, regexp_extract(id, '^(.*)_([0-9]+)$', 1) AS factor, regexp_extract(id, '^(.*)_([0-9]+)$', 2)::INT AS level FROM i""")
def sweep_levels(t):
    """Settings of a sweep over the sizes of parts, read back from their names."""
    sizes = t("part").select("p_size").distinct()
    ids = sizes.select(F.explode(F.array(F.concat(F.lit("rows_"), "p_size"), F.concat(F.lit("wide_features_"), 2 * F.col("p_size")))).alias("id"))
    return ids.select("id", G.sweep_level(F.col("id")).alias("s")).select("id", "s.factor", "s.level")


@query("SELECT count(*) AS n, 6::BIGINT AS features, true AS normal, true AS missing FROM orders")
def synthetic_rows(t):
    """As many rows as there are orders; normal features have mean 0 and deviation 1, and a tenth is missing."""
    n = t("orders").count()
    s = G.row_table(t("region").sparkSession, n, 6, 0.5, 10, 0.1)
    normal = [f.name for f in s.schema if f.dataType == T.DoubleType()]
    a = s.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{c}") for c in normal for k, f in (("m", F.avg), ("d", F.stddev))], F.avg(F.col("f0").isNull().cast("int")).alias("miss"))
    ok = lambda cols: F.forall(F.array(*cols), lambda x: F.abs(x) < 0.1)
    return a.select("n", F.lit(len(s.columns) - 2).cast("long").alias("features"), ok([*[F.col(f"m{c}") for c in normal], *[F.col(f"d{c}") - 1 for c in normal]]).alias("normal"), (F.abs(F.col("miss") - 0.1) < 0.05).alias("missing"))


@query("""WITH o AS (SELECT o_custkey AS t, o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
c AS (SELECT DISTINCT t, unnest([0, 0, 0, 1, 1, 1])::INT AS row, unnest([0, 1, 2, 0, 1, 2])::INT AS col, unnest(['order', 'about', '', '', 'status', 'name']) AS text, -1 AS i FROM o
  UNION ALL SELECT t, (i + 2)::INT, j::INT, CASE j WHEN 0 THEN k::VARCHAR WHEN 1 THEN s ELSE 'order ' || k END, i FROM o, range(3) r(j))
SELECT t AS table_id, row, col, text, CASE WHEN col = 0 THEN [-1, -1, 0, -1] WHEN row = 0 AND col = 1 THEN [-1, -1, 1, -1] WHEN row = 0 THEN [-1, -1, -1, -1] ELSE [-1, -1, 1, col - 1] END AS top,
[-1, -1, -1, i::INT] AS "left" FROM c""")
def header_tree_cells(t):
    """The orders of each customer as a record with a tree of two levels over its columns and a flat one beside its rows."""
    from lakeweave.sources import header_trees

    node = lambda r, c, below="[]": F.concat(F.lit(f'{{"RI": '), r, F.lit(f', "CI": {c}, "Cd": {below}}}'))  # noqa: E731, F541
    about = '[{"RI": 1, "CI": 1, "Cd": []}, {"RI": 1, "CI": 2, "Cd": []}]'
    top = f'{{"Cd": [{{"RI": 0, "CI": 0, "Cd": []}}, {{"RI": 0, "CI": 1, "Cd": {about}}}]}}'
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    parts = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # records are much more work than their bytes tell, so partitions are not joined
    own = orders.repartition(parts, "o_custkey").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    row = lambda x: F.array(x["o_orderkey"].cast("string"), x["o_orderstatus"], F.concat(F.lit("order "), x["o_orderkey"]))
    texts = F.to_json(F.concat(F.array(F.array(*map(F.lit, ("order", "about", ""))), F.array(*map(F.lit, ("", "status", "name")))), F.transform("o", row)))
    left = F.concat(F.lit('{"Cd": ['), F.array_join(F.transform("o", lambda x, i: node((i + 2).cast("string"), 0)), ", "), F.lit("]}"))
    record = F.concat(F.lit('{"Title": "orders", "Texts": '), texts, F.lit(f', "MergedRegions": [], "TopHeaderRowsNumber": 2, "LeftHeaderColumnsNumber": 1, "TopTreeRoot": {top}, "LeftTreeRoot": '), left, F.lit("}"))
    cells = header_trees.read_header_trees(own.select(F.col("o_custkey").alias("table_id"), record.alias("value")))
    return cells.select("table_id", "row", "col", "text", "top", "left")


@query("""SELECT conv_id || ':' || turn AS k, 0::INT AS col_idx, 'k' AS col, conv_id || ':' || turn AS value FROM conversations UNION ALL SELECT conv_id || ':' || turn, 1, 'role', role FROM conversations
UNION ALL SELECT conv_id || ':' || turn, 2, 'said', role || chr(10) || '"' || text || '", ' || role FROM conversations""")
def lake_of_long_records(t):
    """Values with quotes, commas and line ends, in files of several splits."""
    spark, path = folder(t)
    said = F.concat("role", F.lit('\n"'), "text", F.lit('", '), "role")
    own = t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"), "role", said.alias("said"))
    own.coalesce(1).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        cells = LF.read_lake(spark, path)
        own = cells.filter("col = 'k'").select("row_idx", F.col("value").alias("k")).checkpoint()
        return cells.join(own, "row_idx").select("k", "col_idx", "col", "value").checkpoint()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@query("""SELECT CASE WHEN c_custkey % 4 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(c_custkey)::BIGINT AS keys, 3::BIGINT AS features, 'regression' AS task FROM customer GROUP BY 1
UNION ALL SELECT 'all', count(*), sum(c_custkey)::BIGINT, 3, 'regression' FROM customer""")
def dataset_splits(t):
    """Customers as a data set of two files, and as one of a single file, by their splits."""
    spark, path = folder(t)
    c = t("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    for name, rows in (("two/train", c.filter("c_custkey % 4 <> 0")), ("two/test", c.filter("c_custkey % 4 = 0")), ("one/data", c)):
        W.write_table(rows, f"{path}/{name}.csv", ["c_custkey"])
    out = None
    for name, splits in (("two", ("train", "test")), ("one", ("all",))):
        own = D.load(spark, f"{path}/{name}", ["c_acctbal"])
        for split in splits:
            rows = own.split(split, features_only=True)
            one = rows.agg(F.lit(split).alias("split"), F.count("*").alias("n"), F.sum("c_custkey").cast("long").alias("keys"), F.lit(len(rows.columns) - 1).cast("long").alias("features"), F.lit(own.task("c_acctbal")).alias("task"))
            out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT p_partkey, list_concat(list_transform(list_sort([p_partkey, p_size::BIGINT, 100 - p_size]), lambda x: x::VARCHAR), list_sort([p_brand, p_type, 'x' || p_size])) AS keys FROM part""")
def natural_order(t):
    keys = F.array("p_type", F.col("p_size").cast("string"), "p_brand", F.col("p_partkey").cast("string"), F.concat(F.lit("x"), "p_size"), (100 - F.col("p_size")).cast("string"))
    return t("part").select("p_partkey", D.natural_columns(keys).alias("keys"))


@query("SELECT label, count(*) AS n, sum(vec_id)::BIGINT AS ids, true AS kept FROM embeddings GROUP BY label")
def staged_vectors(t):
    """Vectors staged in a folder for each label; to stage them again is an error and leaves them as they are."""
    from pyspark.errors import AnalysisException

    spark, path = folder(t)
    W.write_vectors(t("embeddings"), path, ["label"])
    try:
        W.write_vectors(t("embeddings").limit(0), path, ["label"])
        kept = False
    except AnalysisException:
        kept = True
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids")).withColumn("kept", F.lit(kept))


@query("""SELECT encoding, n FROM (VALUES ('utf-8'), ('utf-16'), ('latin-1')) v(encoding), (SELECT count(*) AS n FROM nation)""")
def encodings_told(t):
    """Nations written in three encodings, told apart by their first bytes and read back."""
    spark, path = folder(t)
    n = t("nation").select(F.concat("n_name", F.lit(" caf\u00e9")).alias("n")).coalesce(1)
    out = None
    for written in ("UTF-8", "UTF-16", "ISO-8859-1"):
        n.write.option("encoding", written).csv(f"{path}/{written}")
        told = D.sniff_encoding(spark, f"{path}/{written}/*.csv")
        rows = spark.read.option("multiLine", True).option("encoding", told.replace("latin-1", "ISO-8859-1")).csv(f"{path}/{written}").filter(F.endswith("_c0", F.lit("caf\u00e9")))
        one = rows.agg(F.lit(told).alias("encoding"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH r AS (SELECT event_id AS seq, json_extract_string(props, '$.k') AS k, event_type AS e FROM events), f AS (SELECT k, e, min(seq) AS seq FROM r GROUP BY k, e)
SELECT row_number() OVER (ORDER BY seq) - 1 AS row_idx, '{"e":"' || e || '","k":"' || k || '"}' AS record FROM f""")
def record_dedup(t):
    """Records that say the same in another order of their keys are one."""
    k = F.get_json_object("props", "$.k")
    there, back = F.format_string('{"k": "%s", "e": "%s"}', k, F.col("event_type")), F.format_string('{"e": "%s", "k": "%s"}', F.col("event_type"), k)
    return R.dedup_records(t("events").select("event_id", F.when(F.col("event_id") % 2 == 0, there).otherwise(back).alias("j")), "j", "event_id")

"""Value overlap, profiling, union and join of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.functions import cleaning as C
from lakeweave.operators import lake as L
from lakeweave.operators import ranks
from lakeweave.operators import retrieval as R

from .registry import query

SPEC = {
    "region": ("r_regionkey", ["r_regionkey", "r_name"]),
    "nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]),
}
ORDER = {c: i for _, cols in SPEC.values() for i, c in enumerate(cols)}
_NORM = "lower(regexp_replace(value, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g'))"
CELLS_SQL = "cells AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_id, {k}::BIGINT AS row_idx, '{c}' AS col, {c}::VARCHAR AS value FROM {t}" for t, (k, cs) in SPEC.items() for c in cs) + ")"
SETS_SQL = f"{CELLS_SQL}, sets AS (SELECT DISTINCT table_id, col, {_NORM} AS value FROM cells WHERE {_NORM} NOT IN ('', 'nan', 'none', 'null', 'n/a', 'na'))"


def cells(t):
    return L.union_all([L.cells(t(name), name, key, cols) for name, (key, cols) in SPEC.items()])


@query(f"WITH {SETS_SQL} SELECT table_id, col, count(*) AS n_values, min(value) AS low, max(value) AS high FROM sets GROUP BY table_id, col")
def value_sets_profile(t):
    return L.value_sets(cells(t)).groupBy("table_id", "col").agg(F.count("*").alias("n_values"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(f"""WITH {SETS_SQL}, size AS (SELECT table_id, col, count(*) AS q_size FROM sets GROUP BY table_id, col),
h AS (SELECT q.table_id AS q_table, q.col AS q_col, c.table_id, c.col, count(*) AS hits FROM sets q JOIN sets c ON q.value = c.value AND q.table_id <> c.table_id GROUP BY ALL)
SELECT h.*, q_size, round(hits / q_size, 6) AS containment, row_number() OVER (PARTITION BY q_table, q_col ORDER BY round(hits / q_size, 6) DESC, h.table_id, h.col) AS rank
FROM h JOIN size s ON s.table_id = q_table AND s.col = q_col QUALIFY rank <= 3""")
def containment_topk(t):
    sets = L.value_sets(cells(t))
    return L.containment_join(sets, sets, 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {SETS_SQL}, few AS (SELECT value FROM sets GROUP BY value HAVING count(*) <= 4)
SELECT table_id, col, count(*) AS n_values FROM sets WHERE value IN (SELECT value FROM few) GROUP BY table_id, col""")
def posting_cap(t):
    return L.capped_postings(L.value_sets(cells(t)), 4).groupBy("table_id", "col").agg(F.count("*").alias("n_values"))


_TOKENS = "SELECT DISTINCT {id} AS id, unnest(string_split_regex(lower({c}), '[^a-z0-9]+')) AS w FROM {t}"


@query(f"""WITH q AS (SELECT * FROM ({_TOKENS.format(id="item_id", c="text", t="benchmark")}) WHERE w <> ''),
d AS (SELECT * FROM ({_TOKENS.format(id="doc_id", c="text", t="documents")}) WHERE w <> ''),
h AS (SELECT q.id AS item_id, d.id AS doc_id, count(*) AS hits FROM q JOIN d USING (w) GROUP BY ALL), n AS (SELECT id, count(*) AS n FROM q GROUP BY id)
SELECT item_id, doc_id, hits, round(hits / n, 6) AS containment, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank
FROM h JOIN n ON n.id = item_id QUALIFY rank <= 5""")
def doc_token_containment(t):
    q = R.postings(t("benchmark").select(F.col("item_id").alias("qid"), "text"), "qid", "text", "[^a-z0-9]+")
    n = q.groupBy(F.col("qid").alias("item_id")).agg(F.count("*").alias("n"))
    out = R.overlaps(q, R.words_of(t("documents"), "doc_id", "did"), 5).withColumnsRenamed({"qid": "item_id", "did": "doc_id"}).join(n, "item_id")
    return out.select("item_id", "doc_id", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("containment"), F.col("rank").cast("long").alias("rank"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier")
def union_aligned_append(t):
    return L.append_aligned(t("customer"), t("supplier"), {"c_custkey": "s_suppkey", "c_name": "s_name", "c_nationkey": "s_nationkey", "c_acctbal": "s_acctbal"})


@query("""SELECT o.o_orderkey, o.key, o.status, c.c_name, c.c_mktsegment AS status_join FROM (SELECT o_orderkey, o_custkey AS key, o_orderstatus AS status FROM orders) o
LEFT JOIN customer c ON c.c_custkey = o.key AND c.c_acctbal > 0""")
def left_join_enrich(t):
    left = t("orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return L.enrich(left, t("customer").filter("c_acctbal > 0").select("c_custkey", "c_name", F.col("c_mktsegment").alias("status")), "key", "c_custkey")


@query("""WITH l AS (SELECT s_suppkey, s_nationkey AS key, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier),
r AS (SELECT c_custkey, c_nationkey AS key, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)
SELECT key, s_suppkey, c_custkey FROM l JOIN r USING (key, n)""")
def one_to_one_key_join(t):
    return L.one_to_one(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("key")), t("customer").select("c_custkey", F.col("c_nationkey").alias("key")), "key", "s_suppkey", "c_custkey")


@query("""SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
AND lower(regexp_replace(c_name, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g')) NOT IN (SELECT lower(s_name) FROM supplier)""")
def anti_new_rows(t):
    new = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").withColumn("_k", C.normalize_key(F.col("c_name")))
    return new.join(t("supplier").select(C.normalize_key(F.col("s_name")).alias("_k")), "_k", "left_anti").select("c_custkey", "c_name")


_BAGS = "a AS (SELECT c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0)"


def bags(t):
    c = t("customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    return c.filter("c_custkey % 3 <> 0").select("v"), c.filter("c_custkey % 2 = 0").select("v")


@query(f"""WITH {_BAGS}, x AS (SELECT v, count(*) AS x FROM a GROUP BY v), y AS (SELECT v, count(*) AS y FROM b GROUP BY v),
s AS (SELECT sum(least(coalesce(x, 0), coalesce(y, 0)))::BIGINT AS tp, sum(x) AS nx, sum(y) AS ny FROM x FULL JOIN y USING (v))
SELECT tp, round(tp / nx, 6) AS precision, round(tp / ny, 6) AS recall, round(2 * tp / (nx + ny), 6) AS f1 FROM s""")
def multiset_f1(t):
    return L.multiset_f1(*bags(t), "v")


@query(f"WITH {_BAGS} SELECT v, count(*) AS n FROM (SELECT v FROM a INTERSECT ALL SELECT v FROM b) GROUP BY v")
def multiset_intersect_all(t):
    a, b = bags(t)
    return a.intersectAll(b).groupBy("v").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT c_mktsegment AS v, CASE WHEN c_custkey % 2 = 0 THEN 'seed' ELSE 'new' END || CASE WHEN c_nationkey < 12 THEN '_in' ELSE '_out' END AS region FROM customer),
e AS (SELECT c_mktsegment AS v, count(*) AS x FROM customer WHERE c_custkey % 5 < 3 GROUP BY 1), y AS (SELECT region, v, count(*) AS y FROM p GROUP BY ALL)
SELECT region, round(sum(least(coalesce(x, 0), y)) / sum(y), 6) AS recall FROM y LEFT JOIN e USING (v) GROUP BY region""")
def region_recall(t):
    c = t("customer")
    region = F.concat(F.when(F.col("c_custkey") % 2 == 0, "seed").otherwise("new"), F.when(F.col("c_nationkey") < 12, "_in").otherwise("_out"))
    e = c.filter("c_custkey % 5 < 3").groupBy(F.col("c_mktsegment").alias("v")).agg(F.count("*").alias("x"))
    y = c.groupBy(region.alias("region"), F.col("c_mktsegment").alias("v")).agg(F.count("*").alias("y"))
    return y.join(e, "v", "left").groupBy("region").agg(F.round(F.sum(F.least(F.coalesce("x", F.lit(0)), F.col("y"))) / F.sum("y"), 6).alias("recall"))


@query("""SELECT round(count(DISTINCT c.c_custkey) FILTER (o.k IS NOT NULL) / count(DISTINCT c.c_custkey), 6) AS recall
FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c.c_custkey""")
def key_recall(t):
    o = t("orders").select(F.col("o_custkey").alias("k")).distinct()
    return t("customer").join(o, F.col("c_custkey") == F.col("k"), "left").agg(F.round(F.countDistinct(F.when(F.col("k").isNotNull(), F.col("c_custkey"))) / F.countDistinct("c_custkey"), 6).alias("recall"))


@query("""SELECT round(count(*) FILTER (b.c IS NOT NULL) / count(*), 6) AS recall FROM (SELECT unnest(['name', 'nationkey', 'acctbal', 'custkey', 'mktsegment']) AS c) a
LEFT JOIN (SELECT unnest(['suppkey', 'name', 'nationkey', 'acctbal']) AS c) b USING (c)""")
def name_recall(t):
    names = lambda name: [c.split("_", 1)[1] for c in t(name).columns]
    own = t("customer").sparkSession.createDataFrame([(c, c in set(names("supplier"))) for c in names("customer")], "c string, met boolean")
    return own.agg(F.round(F.count_if("met") / F.count("*"), 6).alias("recall"))


_PROFILE = f"""{CELLS_SQL}, p AS (SELECT table_id, col, count(*) AS n, count(value) AS n_known, count(DISTINCT lower(value)) AS n_distinct,
count(*) FILTER (value IS NOT NULL AND try_cast(value AS DOUBLE) IS NULL) > 0 AS is_text, max(length(value)) AS width FROM cells GROUP BY table_id, col),
q AS (SELECT table_id, col, n, n_known, n_distinct, round(coalesce(n_distinct / nullif(n_known, 0), 0), 6) AS uniqueness, round(n_known / n, 6) AS known, is_text, width FROM p)"""


@query(f"WITH {_PROFILE} SELECT * FROM q")
def column_profile(t):
    return L.column_profile(cells(t))


_POS = "CASE col " + " ".join(f"WHEN '{c}' THEN {i}" for c, i in ORDER.items()) + " END"


@query(f"WITH {_PROFILE} SELECT * FROM q WHERE uniqueness >= 0.8 AND known >= 0.9 QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY is_text DESC, uniqueness DESC, {_POS}) = 1")
def key_column_pick(t):
    return L.key_column(L.column_profile(cells(t)), F.expr(_POS))


_NUM = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount", "l_tax": "l_tax"}


@query(" UNION ALL ".join(f"""SELECT '{c}' AS col, count({c}) AS n, count(DISTINCT {c}) AS n_distinct, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS deviation, min({c}) AS low, max({c}) AS high,
round(quantile_cont({c}, 0.1), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS q5, round(quantile_cont({c}, 0.9), 4) AS q9 FROM lineitem""" for c in _NUM))
def numeric_sketch(t):
    """Counts of distinct values, dealt out by ranges, give all numbers: no task has all values of a column."""
    x = t("lineitem").select(*_NUM).unpivot([], list(_NUM), "col", "x")
    r = ranks.counted(x, "x", ["col"])
    n, v = F.sum("n"), F.col("x")
    mean = r.groupBy("col").agg((F.sum(F.col("n") * v) / n).alias("m"))
    about = r.join(mean, "col").groupBy("col").agg(
        n.cast("long").alias("n"), F.count("*").alias("n_distinct"), F.round(F.max("m"), 4).alias("mean"),
        F.round(F.sqrt(F.sum(F.col("n") * (v - F.col("m")) ** 2) / n), 4).alias("deviation"), F.min("x").alias("low"), F.max("x").alias("high"),
    )
    q = ranks.quantiles(r, "x", {"q1": 0.1, "q5": 0.5, "q9": 0.9}, ["col"])
    return about.join(q.select("col", *[F.round(c, 4).alias(c) for c in ("q1", "q5", "q9")]), "col")


_H = "min(('0x' || substr(md5('{j}:' || w), {k}, 8))::BIGINT) AS h{i}"


@query(f"WITH d AS (SELECT * FROM ({_TOKENS.format(id='doc_id', c='text', t='documents')}) WHERE w <> '') SELECT id AS doc_id, {', '.join(_H.format(i=i, j=i // 4, k=8 * (i % 4) + 1) for i in range(8))} FROM d GROUP BY id")
def minhash_signature(t):
    words = F.array_remove(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+")), "")
    return L.minhash(t("documents").select("doc_id", words.alias("w")), ["doc_id"], "w", 8)


_SIZES = "sizes AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_id, count(*) AS n_rows, {len(cs)} AS n_cols FROM {t}" for t, (_, cs) in SPEC.items()) + ")"


@query(f"""WITH {_SIZES}, r AS (SELECT CASE WHEN n_rows < 10 THEN 'few_rows' WHEN n_rows > 1500 THEN 'many_rows' WHEN n_cols < 3 THEN 'few_cols' WHEN n_cols > 20 THEN 'many_cols' ELSE 'kept' END AS reason FROM sizes)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def size_filter_reason(t):
    """The first reason, in order, for which a table is passed over."""
    s = cells(t).groupBy("table_id").agg((F.count("*") / F.countDistinct("col")).alias("n_rows"), F.countDistinct("col").alias("n_cols"))
    why = F.when(F.col("n_rows") < 10, "few_rows").when(F.col("n_rows") > 1500, "many_rows").when(F.col("n_cols") < 3, "few_cols").when(F.col("n_cols") > 20, "many_cols").otherwise("kept")
    return s.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), seed AS (SELECT p FROM p WHERE s IN (1, 2))
SELECT s AS candidate, count(*) AS shared FROM p JOIN seed USING (p) WHERE s NOT IN (1, 2) GROUP BY s HAVING count(*) >= 2""")
def cooccurrence_candidates(t):
    p = t("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    seed = p.filter(F.col("s").isin(1, 2)).select("p")
    return p.filter(~F.col("s").isin(1, 2)).join(seed, "p").groupBy(F.col("s").alias("candidate")).agg(F.count("*").alias("shared")).filter("shared >= 2")


@query("SELECT l_partkey AS p, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_suppkey IN (1, 2, 3, 4, 5, 6, 7, 8) GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2")
def set_intersection_count(t):
    return t("lineitem").filter(F.col("l_suppkey").isin(*range(1, 9))).groupBy(F.col("l_partkey").alias("p")).agg(F.countDistinct("l_suppkey").alias("n")).filter("n >= 2")


@query("""WITH s AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://[^/]+(/[^?#]*)?', 1) AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '\\.(csv|tsv|json|xlsx?|zip|gz)$') THEN 'direct' WHEN regexp_matches(path, '^/dataset/|/api/3/action/') THEN 'ckan'
WHEN regexp_matches(path, '/resource/[a-z0-9]{4}-[a-z0-9]{4}|/d/[a-z0-9]{4}-[a-z0-9]{4}') THEN 'socrata' ELSE 'generic' END AS kind FROM s""")
def url_classify(t):
    return t("pages").select("page_id", C.url_kind(F.col("url")).alias("kind"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS props_k FROM events")
def json_flatten(t):
    return t("events").select("event_id", F.from_json("props", "k long").alias("props")).select("event_id", F.col("props.k").alias("props_k"))


@query('''SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'SELL, "it"' WHEN 1 THEN ' x ' WHEN 2 THEN '' ELSE 'plain' END AS raw,
CASE event_id % 4 WHEN 0 THEN '"SELL, ""it"""' WHEN 1 THEN ' x ' WHEN 2 THEN '' ELSE 'plain' END AS escaped,
CASE event_id % 4 WHEN 0 THEN 'sell, "it"' WHEN 1 THEN 'x' WHEN 2 THEN NULL ELSE 'plain' END AS cleaned FROM events''')
def scalar_cleaning(t):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, 'SELL, "it"').when(k == 1, " x ").when(k == 2, "").otherwise("plain")
    return t("events").select("event_id", raw.alias("raw"), C.csv_escape(raw).alias("escaped"), C.normalize_value(raw).alias("cleaned"))


@query("""WITH v AS (SELECT c_nationkey, '$' || (c_custkey * 1000)::VARCHAR || CASE WHEN c_custkey % 7 = 0 THEN ' units' ELSE '' END AS x FROM customer),
n AS (SELECT c_nationkey, try_cast(regexp_replace(x, '[,$%]', '', 'g') AS DOUBLE) AS y FROM v) SELECT c_nationkey, count(y) AS n, sum(y) AS total, round(avg(y), 6) AS mean FROM n GROUP BY c_nationkey""")
def cell_aggregate(t):
    x = F.concat(F.lit("$"), (F.col("c_custkey") * 1000).cast("string"), F.when(F.col("c_custkey") % 7 == 0, " units").otherwise(""))
    return t("customer").select("c_nationkey", C.number(x).alias("y")).groupBy("c_nationkey").agg(F.count("y").alias("n"), F.sum("y").alias("total"), F.round(F.avg("y"), 6).alias("mean"))


_NUMBERS = {"c_acctbal": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END", "c_nationkey": "c_nationkey", "two": "c_custkey % 2", "one": "7", "none": "NULL"}
_TEXTS = {"c_name": "c_name", "c_mktsegment": "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END"}
_FIGURES = [*[f"round(quantile_cont(x, {i / 10}), 4)" for i in range(1, 10)], "round(avg(x), 4)", "CASE WHEN count(DISTINCT x) + (count(*) > count(x))::INT > 2 THEN round(stddev_pop(x), 4) ELSE 0 END", "round(min(x), 4)", "round(max(x), 4)"]
_FIGURE_NAMES = [*[f"q{i}" for i in range(1, 10)], "mean", "deviation", "low", "high"]


@query(" UNION ALL ".join(
    [f"""SELECT '{c}' AS col, 'number' AS kind, count(*) - count(x) AS n_null, count(DISTINCT x) + (count(*) > count(x))::INT AS n_unique,
    {', '.join(f"CASE WHEN count(DISTINCT x) + (count(*) > count(x))::INT > 1 THEN {f} END AS {n}" for f, n in zip(_FIGURES, _FIGURE_NAMES, strict=True))}, NULL::DOUBLE AS width FROM (SELECT ({x})::DOUBLE AS x FROM customer)""" for c, x in _NUMBERS.items()]
    + [f"""SELECT '{c}', 'text', count(*) - count(x), count(DISTINCT x) + (count(*) > count(x))::INT, {', '.join('NULL::DOUBLE' for _ in _FIGURE_NAMES)}, round(sum(coalesce(strlen(x), 0)) / count(*), 4)
    FROM (SELECT nullif({x}, '') AS x FROM customer)""" for c, x in _TEXTS.items()]
))
def column_sketch(t):
    df = t("customer").select(*[F.expr(x).alias(c) for c, x in {**_NUMBERS, **_TEXTS}.items()])
    return L.column_sketch(df, list(_NUMBERS), list(_TEXTS))


@query(f"WITH {CELLS_SQL} SELECT table_id, col, arg_min(value, row_idx) AS value FROM cells WHERE trim(value) <> '' GROUP BY table_id, col")
def sample_values(t):
    return L.sample_values(cells(t))

"""Serialisation, types, vocabularies, weights and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.functions import cleaning as C
from lakeweave.functions import serialise as S
from lakeweave.operators import checks
from lakeweave.operators import lake as L
from lakeweave.operators import prepare as P
from lakeweave.operators import ranks
from lakeweave.operators import retrieval as R

from .lake_queries import CELLS_SQL, cells
from .prepare_queries import _POST, md5_sql
from .registry import query


@query("SELECT c_custkey, 'c_name: ' || substr(c_name, 1, 100) || ' | c_mktsegment: ' || substr(c_mktsegment, 1, 100) || ' | c_nationkey: ' || substr(c_nationkey::VARCHAR, 1, 100) AS text FROM customer")
def row_serialise(t):
    return t("customer").select("c_custkey", S.row_text(["c_name", "c_mktsegment", "c_nationkey"]).alias("text"))


@query("SELECT n_regionkey, 'n_nationkey | n_name . ' || string_agg(n_nationkey || ' | ' || n_name, ' . ' ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def table_linearise(t):
    return S.table_text(t("nation"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"])


@query(f"""WITH {CELLS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY table_id, col ORDER BY row_idx) AS n FROM cells WHERE value IS NOT NULL QUALIFY n <= 10)
SELECT table_id, col, col || ': ' || string_agg(value, ', ' ORDER BY n) AS text FROM f GROUP BY table_id, col""")
def column_serialise(t):
    return S.column_text(cells(t), 10)


@query(f"""WITH {CELLS_SQL} SELECT table_id, col, CASE WHEN bool_and(regexp_full_match(value, '[+-]?[0-9]+')) THEN 'integer' WHEN bool_and(try_cast(value AS DOUBLE) IS NOT NULL) THEN 'float'
WHEN bool_and(regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) THEN 'date' ELSE 'string' END AS type FROM cells WHERE value IS NOT NULL GROUP BY table_id, col""")
def column_types(t):
    return S.column_types(cells(t))


_W = "w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents)"


@query(f"WITH {_W}, n AS (SELECT w, count(*) AS n FROM w WHERE w <> '' GROUP BY w HAVING count(*) >= 3) SELECT w, n, row_number() OVER (ORDER BY n DESC, w) - 1 AS id FROM n QUALIFY id < 200")
def vocabulary_build(t):
    return S.vocabulary(t("documents").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("w")).filter("w <> ''"), "w", 200, 3)


@query("""WITH q0 AS (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM benchmark), p AS (SELECT item_id, w, count(*) AS tf FROM q0 WHERE w <> '' GROUP BY ALL),
d AS (SELECT w, count(*) AS df FROM p GROUP BY w), n AS (SELECT count(DISTINCT item_id) AS n FROM p), x AS (SELECT item_id, p.w, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM p JOIN d USING (w), n),
l AS (SELECT item_id, sqrt(sum(x * x)) AS l FROM x GROUP BY item_id) SELECT item_id, w, round(x / l, 6) AS weight FROM x JOIN l USING (item_id)""")
def tfidf_weights(t):
    return S.tf_idf(R.postings(t("benchmark"), "item_id", "text", "[^a-z0-9]+"), "item_id")


@query("""WITH p AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM benchmark) WHERE w <> ''),
v AS (SELECT w FROM p GROUP BY w ORDER BY count(*) DESC, w LIMIT 300), x AS (SELECT * FROM p WHERE w IN (FROM v)), n AS (SELECT item_id, count(*) AS n FROM x GROUP BY item_id)
SELECT a.item_id AS a, b.item_id AS b, round(count(*) / sqrt(any_value(na.n) * any_value(nb.n)), 6) AS cosine FROM x a JOIN x b ON a.w = b.w AND a.item_id < b.item_id
JOIN n na ON na.item_id = a.item_id JOIN n nb ON nb.item_id = b.item_id GROUP BY a.item_id, b.item_id""")
def capped_token_cosine(t):
    """Cosines of binary vectors over a vocabulary of the 300 commonest words."""
    p = S.capped(R.postings(t("benchmark"), "item_id", "text", "[^a-z0-9]+"), 300).select("item_id", "w")
    n = p.groupBy("item_id").agg(F.count("*").alias("n"))
    both = p.withColumnRenamed("item_id", "a").join(p.withColumnRenamed("item_id", "b"), "w").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("x"))
    sized = both.join(n.select(F.col("item_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("item_id").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", F.round(F.col("x") / F.sqrt(F.col("na") * F.col("nb")), 6).alias("cosine"))


@query("""WITH a AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark)
SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.w, y.w)) / sqrt(len(x.w) * len(y.w)), 6) AS cosine FROM a x JOIN a y ON x.item_id < y.item_id AND len(list_intersect(x.w, y.w)) > 0""")
def binary_token_cosine(t):
    """Pairs that share a word, by a join on words; all others have 0 and are left out."""
    p = R.postings(t("benchmark"), "item_id", "text", "[^a-z0-9]+").select("item_id", "w")
    n = p.groupBy("item_id").agg(F.count("*").alias("n"))
    both = p.withColumnRenamed("item_id", "a").join(p.withColumnRenamed("item_id", "b"), "w").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("x"))
    out = both.join(n.select(F.col("item_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("item_id").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", F.round(F.col("x") / F.sqrt(F.col("na") * F.col("nb")), 6).alias("cosine"))


@query(f"WITH {_POST}, n AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id) SELECT doc_id, round(log10(n), 6) AS score FROM n")
def literal_tfidf(t):
    """As the survey states it: each word of a column scores log10 of the column's number of distinct words."""
    return R.postings(t("documents"), "doc_id", "text", "[^a-z0-9]+").groupBy("doc_id").agg(F.round(F.log10(F.count("*")), 6).alias("score"))


@query(f"""WITH {_W}, f AS (SELECT doc_id, w, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL) SELECT doc_id, w, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS rank FROM f QUALIFY rank <= 5""")
def frequent_token_sample(t):
    p = R.postings(t("documents"), "doc_id", "text", "[^a-z0-9]+").withColumnRenamed("tf", "n")
    return L.top_k(p, ["doc_id"], 5, F.col("n").desc(), F.col("w")).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\\.(gz|bz2)$', ''), '\\.csv$', '') AS stem, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS file_name FROM pages")
def file_names(t):
    return t("pages").select("page_id", C.file_stem(F.col("url")).alias("stem"), C.safe_file_name(F.col("url")).alias("file_name"))


@query("""WITH a AS (SELECT c_custkey AS id, c_name AS alias, 0 AS p FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 1 FROM customer)
SELECT alias, id FROM a QUALIFY row_number() OVER (PARTITION BY alias ORDER BY id, p) = 1""")
def alias_lookup(t):
    """Each record can be reached by several names; the first one that claims a name keeps it."""
    a = t("customer").select(F.col("c_custkey").alias("id"), F.posexplode(F.array("c_name", "c_mktsegment")).alias("p", "alias"))
    return a.groupBy("alias").agg(F.min(F.struct("id", "p")).alias("x")).select("alias", "x.id")


@query("WITH e AS (SELECT n_regionkey AS r, unnest(range(0, 25)) AS p FROM (SELECT DISTINCT n_regionkey FROM nation)) SELECT r, count(*) AS missing, min(p) AS first FROM e WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r AND n.n_nationkey = p) GROUP BY r")
def detect_missing(t):
    n = t("nation")
    want = n.select(F.col("n_regionkey").alias("r")).distinct().withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(24))))
    return want.join(n.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("p")), ["r", "p"], "left_anti").groupBy("r").agg(F.count("*").alias("missing"), F.min("p").alias("first"))


@query("SELECT item_id, bool_or(contains(lower(text), 'th') OR contains(lower(text), 'qu')) AS met FROM benchmark GROUP BY item_id")
def answer_in_table(t):
    wanted = F.array(F.lit("TH"), F.lit("Qu"))
    return t("benchmark").select("item_id", F.exists(wanted, lambda a: F.contains(F.lower("text"), F.lower(a))).alias("met"))


@query(f"""WITH s AS (SELECT l_partkey, CASE WHEN {md5_sql('leak', 'l_orderkey')} % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM lineitem)
SELECT count(*) AS overlap FROM (SELECT l_partkey FROM s WHERE split = 'train' INTERSECT SELECT l_partkey FROM s WHERE split = 'test')""")
def split_leakage(t):
    s = t("lineitem").select("l_partkey", (P.keyed("leak", "l_orderkey") % 2).alias("half"))
    return s.filter("half = 0").select("l_partkey").intersect(s.filter("half = 1").select("l_partkey")).agg(F.count("*").alias("overlap"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS c FROM lineitem), n AS (SELECT k FROM d GROUP BY k HAVING count(*) >= 2)
SELECT a.k, a.c AS c1, b.c AS c2 FROM d a JOIN d b ON a.k = b.k AND a.c < b.c WHERE a.k IN (SELECT k FROM n)""")
def annotated_column_pairs(t):
    d = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("c")).distinct()
    return d.withColumnRenamed("c", "c1").join(d.withColumnRenamed("c", "c2"), "k").filter("c1 < c2").select("k", "c1", "c2")


@query("""WITH a AS (SELECT n_regionkey AS t, list(n_nationkey ORDER BY n_nationkey) AS m FROM nation GROUP BY 1), x AS (SELECT t, unnest(m) AS p, generate_subscripts(m, 1) - 1 AS i FROM a),
y AS (SELECT s_nationkey % 5 AS t, min(s_suppkey) AS i, s_nationkey AS p FROM supplier GROUP BY 1, 3)
SELECT x.t, x.p, x.i AS left_pos, min(y.i) AS right_pos FROM x JOIN y ON x.p = y.p AND x.t = y.t GROUP BY ALL""")
def ground_truth_alignment(t):
    """Positions on both sides that come from one parent column; the first match on the right counts."""
    m = t("nation").groupBy(F.col("n_regionkey").alias("t")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("m"))
    x = m.select("t", F.posexplode("m").alias("left_pos", "p"))
    y = t("supplier").groupBy((F.col("s_nationkey") % 5).alias("t"), F.col("s_nationkey").alias("p")).agg(F.min("s_suppkey").alias("right_pos"))
    return x.join(y, ["t", "p"]).select("t", "p", "left_pos", "right_pos")


@query("""WITH v AS (SELECT 'o' || l_orderkey % 400 AS t, l_partkey AS v FROM lineitem), s AS (SELECT DISTINCT t, v FROM v), n AS (SELECT t, count(*) AS n FROM s GROUP BY t),
o AS (SELECT a.t AS q, b.t AS c, count(*) / max(n) AS o FROM s a JOIN s b ON a.v = b.v AND a.t <> b.t JOIN n ON n.t = a.t GROUP BY ALL)
SELECT q, count(*) FILTER (o < 0.15) AS hard, count(*) FILTER (o >= 0.15) AS easy FROM o GROUP BY q HAVING count(*) FILTER (o < 0.15) >= 5""")
def hard_positive_filter(t):
    """Queries with five hard positives (overlap under .15) or more; easy ones are counted apart."""
    s = t("lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey") % 400).alias("t"), F.col("l_partkey").alias("v"))
    n = s.distinct().groupBy(F.col("t").alias("q")).agg(F.count("*").alias("n"))
    o = L.shared_values(s).join(n, "q").withColumn("o", F.col("x") / F.col("n"))
    return o.groupBy("q").agg(F.count_if(F.col("o") < 0.15).alias("hard"), F.count_if(F.col("o") >= 0.15).alias("easy")).filter("hard >= 5")


@query("""WITH s AS (SELECT DISTINCT 'a' || l_linenumber AS c, l_suppkey AS v FROM lineitem), n AS (SELECT c, count(*) AS n FROM s GROUP BY c),
o AS (SELECT a.c AS a, b.c AS b, count(*) AS x FROM s a JOIN s b ON a.v = b.v AND a.c < b.c GROUP BY ALL)
SELECT o.a, o.b, round(x / (p.n + q.n - x), 6) AS jaccard, round(x / p.n, 6) AS containment FROM o JOIN n p ON p.c = o.a JOIN n q ON q.c = o.b""")
def column_pair_overlap(t):
    s = t("lineitem").select(F.concat(F.lit("a"), F.col("l_linenumber")).alias("c"), F.col("l_suppkey").alias("v")).distinct()
    n = s.groupBy("c").agg(F.count("*").alias("n"))
    o = s.withColumnRenamed("c", "a").join(s.withColumnRenamed("c", "b"), "v").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("x"))
    o = o.join(n.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
    return o.select("a", "b", F.round(F.col("x") / (F.col("na") + F.col("nb") - F.col("x")), 6).alias("jaccard"), F.round(F.col("x") / F.col("na"), 6).alias("containment"))


@query("""SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY event_type""")
def median_iqr(t):
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return t("events").groupBy("event_type").agg(q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"))


@query(f"""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY -ln(({md5_sql('pick', 'event_id')} + 1) / 2147483649.0) / (value + 1), event_id) <= 3""")
def weighted_sample(t):
    """Three of each group without replacement, by weight: the smallest exponential keys win."""
    key = -F.log((P.keyed("pick", "event_id") + 1) / F.lit(2147483649.0)) / (F.col("value") + 1)
    return L.top_k(t("events"), ["user_id"], 3, key, F.col("event_id")).select("user_id", "event_id")


@query("""WITH RECURSIVE e AS (SELECT * FROM (VALUES ('num_list', 'ordered_list'), ('datetime_list', 'ordered_list'), ('ordered_list', 'atom_list'), ('string_list', 'atom_list'), ('atom_list', 'list'), ('entity_list', 'list')) v(a, b)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'num_list' WHEN event_type = 'purchase' THEN 'datetime_list' WHEN event_type = 'error' THEN 'entity_list' ELSE 'string_list' END AS kind FROM events)
SELECT kind, b AS ancestor, count(*) AS n FROM k JOIN r ON r.a = kind GROUP BY ALL""")
def type_closure(t):
    """Events, each with a type of the language, under all that their types also are."""
    from lakeweave.operators.program import TYPES, ancestors

    kind = F.when(F.col("event_type") == "click", "num_list").when(F.col("event_type") == "purchase", "datetime_list").when(F.col("event_type") == "error", "entity_list").otherwise("string_list")
    above = F.create_map(*[c for k in TYPES for c in (F.lit(k), F.array(*map(F.lit, sorted(ancestors(k) - {k}))).cast("array<string>"))])
    return t("events").select(kind.alias("kind")).select("kind", F.explode(above[F.col("kind")]).alias("ancestor")).groupBy("kind", "ancestor").agg(F.count("*").alias("n"))


_RECORDS = """r AS (SELECT CASE WHEN vec_id % 71 = 0 THEN NULL ELSE vec_id // 8 END AS table_id, CASE WHEN vec_id % 37 = 0 THEN 'x' || vec_id ELSE (vec_id % 8)::VARCHAR END AS column_key,
CASE WHEN vec_id % 41 = 0 THEN list_concat(['nan'::DOUBLE], (embedding::DOUBLE[])[2:]) WHEN vec_id % 43 = 0 THEN list_concat(['inf'::DOUBLE], (embedding::DOUBLE[])[2:]) WHEN vec_id % 47 = 0 THEN (embedding::DOUBLE[])[:63]
WHEN vec_id % 53 = 0 THEN [] ELSE embedding::DOUBLE[] END AS v, vec_id FROM embeddings UNION ALL SELECT vec_id // 8, (vec_id % 8)::VARCHAR, embedding::DOUBLE[], vec_id FROM embeddings WHERE vec_id % 59 = 0),
w AS (SELECT vec_id // 8 AS table_id FROM embeddings WHERE vec_id % 104 < 96 UNION SELECT 100000 + vec_id FROM embeddings WHERE vec_id % 100 = 0)"""


@query(f"""WITH {_RECORDS}, h AS (SELECT DISTINCT table_id FROM r WHERE table_id IS NOT NULL)
SELECT 'missing field' AS rule, count(*) FILTER (table_id IS NULL OR column_key IS NULL OR v IS NULL) AS n FROM r UNION ALL SELECT 'key is no number', count(*) FILTER (TRY_CAST(column_key AS INT) IS NULL) FROM r
UNION ALL SELECT 'another size than stated', count(*) FILTER (len(v) <> 64) FROM r UNION ALL SELECT 'empty vector', count(*) FILTER (len(v) = 0) FROM r
UNION ALL SELECT 'null or infinite element', count(*) FILTER (len([1 FOR x IN v IF x IS NULL OR NOT isfinite(x)]) > 0) FROM r
UNION ALL SELECT 'repeated column', count(*) FROM (SELECT 1 FROM r GROUP BY table_id, column_key HAVING count(*) > 1)
UNION ALL SELECT 'sizes mixed in a table', count(*) FROM (SELECT 1 FROM r GROUP BY table_id HAVING count(DISTINCT len(v)) > 1)
UNION ALL SELECT 'missing table', count(*) FROM w WHERE table_id NOT IN (FROM h) UNION ALL SELECT 'extra table', count(*) FROM h WHERE table_id NOT IN (FROM w)
UNION ALL SELECT 'missing column', count(*) FROM (SELECT DISTINCT vec_id // 8 AS table_id, (vec_id % 8)::VARCHAR AS column_key FROM embeddings) c WHERE table_id IN (FROM h) AND NOT EXISTS (FROM r WHERE r.table_id = c.table_id AND r.column_key = c.column_key)""")
def record_checks(t):
    """Vector records with planted faults against every rule."""
    i, v = F.col("vec_id"), F.col("embedding").cast("array<double>")
    rest, first = F.slice(v, 2, 63), lambda x: F.array(F.lit(float(x)))
    e = t("embeddings")
    spoilt = F.when(i % 41 == 0, F.concat(first("nan"), rest)).when(i % 43 == 0, F.concat(first("inf"), rest)).when(i % 47 == 0, F.slice(v, 1, 63)).when(i % 53 == 0, F.array().cast("array<double>")).otherwise(v)
    table, key = F.floor(i / 8), (i % 8).cast("string")
    r = e.select(F.when(i % 71 != 0, table).alias("table_id"), F.when(i % 37 == 0, F.concat(F.lit("x"), i)).otherwise(key).alias("column_key"), spoilt.alias("v"))
    r = r.unionByName(e.filter(i % 59 == 0).select(table.alias("table_id"), key.alias("column_key"), v.alias("v"))).withColumn("size", F.lit(64))
    tables = e.filter(i % 104 < 96).select(table.alias("table_id")).unionByName(e.filter(i % 100 == 0).select((100000 + i).alias("table_id")))
    return checks.check_records(r, tables, e.select(table.alias("table_id"), key.alias("column_key")))


@query("""WITH a AS (SELECT len(embedding) - (vec_id % 97 = 0)::INT AS size FROM embeddings), b AS (SELECT len(embedding) AS size FROM embeddings WHERE vec_id % 2 = 0)
SELECT size, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM (SELECT size, count(*) AS n_a FROM a GROUP BY size) FULL JOIN (SELECT size, count(*) AS n_b FROM b GROUP BY size) USING (size)""")
def record_sizes(t):
    e = t("embeddings").select("vec_id", F.col("embedding").alias("v"))
    short = F.when(F.col("vec_id") % 97 == 0, F.slice("v", 1, 63)).otherwise(F.col("v"))
    return checks.compatible(e.select(short.alias("v")), e.filter("vec_id % 2 = 0").select("v"))
@query("""WITH r AS (SELECT c_nationkey AS q, c_acctbal AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, c_custkey % 4 AS gain FROM customer QUALIFY rank <= 10)
SELECT q, round(sum(gain / log2(rank + 1)), 6) AS dcg, round(sum(CASE WHEN rank = 1 THEN gain ELSE gain / log2(rank) END), 6) AS dcg_first, round(avg((gain > 0)::INT), 6) AS p10 FROM r GROUP BY q""")
def graded_dcg(t):
    """Both conventions of the discount."""
    r = L.top_k(t("customer").withColumn("gain", F.col("c_custkey") % 4), ["c_nationkey"], 10, F.col("c_acctbal").desc(), F.col("c_custkey"))
    one = F.when(F.col("rank") == 1, F.col("gain").cast("double")).otherwise(F.col("gain") / F.log2("rank"))
    return r.groupBy(F.col("c_nationkey").alias("q")).agg(F.round(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)), 6).alias("dcg"), F.round(F.sum(one), 6).alias("dcg_first"), F.round(F.avg((F.col("gain") > 0).cast("int")), 6).alias("p10"))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: exp(x)) AS e, label AS y FROM embeddings), q AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p, y FROM p)
SELECT round(avg((list_position(p, list_max(p)) - 1 = y)::INT), 6) AS accuracy, round(avg(list_max(p)), 6) AS confidence FROM q""")
def softmax_accuracy(t):
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.exp(x))
    z = F.aggregate(F.col("e"), F.lit(0.0), lambda s, x: s + x)
    q = t("embeddings").select(e.alias("e"), F.col("label").alias("y")).select(F.transform("e", lambda x: x / z).alias("p"), "y")
    hit = (F.array_position("p", F.array_max("p")) - 1 == F.col("y")).cast("int")
    return q.agg(F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg(F.array_max("p")), 6).alias("confidence"))


@query("""WITH x AS (SELECT p_partkey, [p_size % 2, p_partkey % 3 % 2, p_size % 5 % 2] AS a, [p_size % 2, p_partkey % 2, p_size % 3 % 2] AS b FROM part)
SELECT round(avg((a = b)::INT), 6) AS subset, round(avg(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] = z[2])::INT)) / 3), 6) AS hamming FROM x""")
def multilabel_accuracy(t):
    bit = lambda c: (c % 2).cast("int")
    s, k = F.col("p_size"), F.col("p_partkey")
    x = t("part").select(F.array(bit(s), bit(k % 3), bit(s % 5)).alias("a"), F.array(bit(s), bit(k), bit(s % 3)).alias("b"))
    same = F.aggregate(F.zip_with("a", "b", lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, v: n + v) / 3
    return x.agg(F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("subset"), F.round(F.avg(same), 6).alias("hamming"))


@query("""WITH u AS (SELECT p_size AS k, count(*) FILTER (p_partkey % 3 = 0) / count(*) AS u, count(*) FILTER (p_partkey % 2 = 0) / count(*) AS j FROM part GROUP BY 1)
SELECT k, round(u, 6) AS union_recall, round(j, 6) AS join_recall, round(coalesce(2 * u * j / nullif(u + j, 0), 0), 6) AS harmonic FROM u""")
def union_join_harmonic(t):
    n = F.count("*")
    u, j = F.count_if(F.col("p_partkey") % 3 == 0) / n, F.count_if(F.col("p_partkey") % 2 == 0) / n
    h = F.coalesce(F.try_divide(2 * F.col("u") * F.col("j"), F.col("u") + F.col("j")), F.lit(0.0))
    return t("part").groupBy(F.col("p_size").alias("k")).agg(u.alias("u"), j.alias("j")).select("k", F.round("u", 6).alias("union_recall"), F.round("j", 6).alias("join_recall"), F.round(h, 6).alias("harmonic"))


@query("""WITH p AS (SELECT l_partkey AS a, l_suppkey AS b, max(l_quantity) AS s FROM lineitem GROUP BY 1, 2), k AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, max(s) OVER (PARTITION BY least(a, b), greatest(a, b)) AS s FROM p)
SELECT a, b, (s >= 40)::INT AS label FROM k""")
def unordered_pair_labels(t):
    """A pair counts once, whichever way round; scores over the threshold are positives."""
    p = t("lineitem").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.max("l_quantity").alias("s"))
    return p.select("a", "b", (F.col("s") >= 40).cast("int").alias("label"))


@query("""WITH f AS (SELECT 'f' || event_id % 3 AS f, user_id % 11 AS model, event_type AS variant FROM events WHERE value > 20) SELECT model, variant FROM f GROUP BY ALL HAVING count(DISTINCT f) = 3""")
def common_variants(t):
    return t("events").filter("value > 20").groupBy((F.col("user_id") % 11).alias("model"), F.col("event_type").alias("variant")).agg(F.countDistinct(F.col("event_id") % 3).alias("n")).filter("n = 3").drop("n")


@query("""SELECT 'orders without customer' AS rule, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'vectors of another size', count(*) FROM embeddings WHERE len(embedding) <> 64 UNION ALL SELECT 'negative quantity', count(*) FROM lineitem WHERE l_quantity < 0""")
def quality_assertions(t):
    n = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count("*").alias("n"))
    lost = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return L.union_all([n("orders without customer", lost), n("vectors of another size", t("embeddings").filter("size(embedding) <> 64")), n("negative quantity", t("lineitem").filter("l_quantity < 0"))])


@query("""SELECT conv_id, string_agg(role || ': ' || text, ' | ' ORDER BY turn) AS text, count(*) AS turns FROM conversations GROUP BY conv_id""")
def grouped_linearise(t):
    x = F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("t"))
    g = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(x)).alias("r"), F.count("*").alias("turns"))
    return g.select("conv_id", F.array_join(F.transform("r", lambda y: y["t"]), " | ").alias("text"), "turns")


@query("""WITH r AS (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events), f AS (SELECT k, min(event_id) AS seq FROM r GROUP BY k) SELECT row_number() OVER (ORDER BY seq) - 1 AS row_idx, k FROM f""")
def record_content_dedup(t):
    """Records of equal content are one; numbers follow first occurrence."""
    r = t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).groupBy("k").agg(F.min("event_id").alias("seq"))
    return ranks.numbered(r, "seq", "row_idx").select("row_idx", "k")


@query()
def answer_normalise(t):
    return t("documents").select("doc_id", S.normal_answer(F.col("text")).alias("text"))


_TOKENS_SQL = r"x AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\f\x0B]+'), lambda w: w <> '') AS w FROM benchmark)"
for _how, _expr in {
    "head": "w[1:12]",
    "alpha_head": "list_sort(list_distinct(w))[1:12]",
    "nth": "list_filter(w, lambda v, i: (i - 1) % greatest(1, len(w) // 12) = 0)[1:12]",
}.items():

    def _sampled(t, how=_how):
        return S.token_sample(t("benchmark"), "item_id", "text", how, 12)

    query(f"WITH {_TOKENS_SQL} SELECT item_id, {_expr} AS tokens FROM x", name=f"token_sample_{_how}")(_sampled)


@query()
def token_sample_random(t):
    return S.token_sample(t("benchmark"), "item_id", "text", "random", 12)

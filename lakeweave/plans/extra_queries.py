"""Grid searches, gaps between stages, filters by budget and entity ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.functions import vectors as V
from lakeweave.operators import lake as L

from .registry import query
from .vector_queries import E_SQL


@query(f"WITH {E_SQL} SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-8), 6) AS score FROM e a JOIN e b ON b.id = a.id + 10")
def pair_cosine_scores(t):
    e = t("embeddings").select("vec_id", F.col("embedding").alias("v"))
    both = e.select(F.col("vec_id").alias("a"), "v").join(e.select((F.col("vec_id") - 10).alias("a"), F.col("vec_id").alias("b"), F.col("v").alias("w")), "a")
    return both.select("a", "b", F.round(V.dot(F.col("v"), F.col("w")) / (V.norm(F.col("v")) * V.norm(F.col("w")) + 1e-8), 6).alias("score"))


_GRID = [(u, m, j) for u in (0.2, 0.4, 0.6) for m in (10, 20, 30) for j in (15, 25, 35)]


@query(f"""WITH g AS (SELECT * FROM (VALUES {", ".join(f"({i}, {u}::DOUBLE, {m}::DOUBLE, {j}::DOUBLE)" for i, (u, m, j) in enumerate(_GRID))}) v(i, u, m, j)),
p AS (SELECT p_partkey, p_size AS s, (p_partkey % 10) / 10 AS r, p_partkey % 3 AS y FROM part),
x AS (SELECT i, y, CASE WHEN r >= u AND s >= m THEN 0 WHEN s >= j THEN 1 ELSE 2 END AS c, count(*) AS n FROM p, g GROUP BY ALL),
f AS (SELECT i, k, coalesce(sum(n) FILTER (y = k AND c = k), 0) AS tp, coalesce(sum(n) FILTER (y <> k AND c = k), 0) AS fp, coalesce(sum(n) FILTER (y = k AND c <> k), 0) AS fn FROM x, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL),
m AS (SELECT i, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9) AS f1 FROM f GROUP BY i)
SELECT i::INT AS i, f1 FROM m ORDER BY f1 DESC, i LIMIT 1""")
def threshold_grid_search(t):
    """All settings of a fixed grid in one pass: each row is put in a class for each setting, only counts are shuffled; the first best wins."""
    g = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(u)).alias("u"), F.lit(float(m)).alias("m"), F.lit(float(j)).alias("j")) for i, (u, m, j) in enumerate(_GRID)])
    p = t("part").select(F.col("p_size").alias("s"), ((F.col("p_partkey") % 10) / 10).alias("r"), (F.col("p_partkey") % 3).cast("int").alias("y"), F.explode(g).alias("g"))
    c = F.when((F.col("r") >= F.col("g.u")) & (F.col("s") >= F.col("g.m")), 0).when(F.col("s") >= F.col("g.j"), 1).otherwise(2)
    x = p.groupBy(F.col("g.i").alias("i"), "y", c.alias("c")).agg(F.count("*").alias("n"))
    k = x.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    y, said, own = F.col("y"), F.col("c"), F.col("k")
    f = k.groupBy("i", "k").agg(n((y == own) & (said == own)).alias("tp"), n((y != own) & (said == own)).alias("fp"), n((y == own) & (said != own)).alias("fn"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return f.groupBy("i").agg(F.round(F.avg(f1), 9).alias("f1")).orderBy(F.col("f1").desc(), "i").limit(1)


@query("SELECT page_id, CASE WHEN regexp_matches(url, 'https?://[^/]*[0-9]') THEN 'query' WHEN page_id % 2 = 0 THEN 'target' ELSE 'distractor' END AS role FROM pages")
def record_roles(t):
    role = F.when(F.col("url").rlike("https?://[^/]*[0-9]"), "query").when(F.col("page_id") % 2 == 0, "target").otherwise("distractor")
    return t("pages").select("page_id", role.alias("role"))


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN l.l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS total, count(*) FILTER (n.n <= 4) AS kept
FROM lineitem l LEFT JOIN n USING (l_orderkey) GROUP BY 1""")
def column_budget_filter(t):
    """Samples whose table has four columns or fewer; kept and total of each split."""
    n = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    split = F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train")
    return t("lineitem").join(n, "l_orderkey", "left").groupBy(split.alias("split")).agg(F.count("*").alias("total"), F.count_if(F.col("n") <= 4).alias("kept"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, l_linenumber FROM r WHERE l_linenumber <= least(n, 3)""")
def truncate_to_vectors(t):
    """As many rows as there are vectors (three) or rows, whichever is less."""
    n = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return t("lineitem").join(n, "l_orderkey").filter(F.col("l_linenumber") <= F.least(F.col("n"), F.lit(3))).select("l_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT o_orderpriority AS model, o_orderstatus AS stage, avg(o_totalprice) AS m FROM orders GROUP BY ALL)
SELECT model, round(max(m) FILTER (stage = 'F'), 4) AS plain, round(max(m) FILTER (stage = 'O') - max(m) FILTER (stage = 'F'), 4) AS gap_1, round(max(m) FILTER (stage = 'P') - max(m) FILTER (stage = 'O'), 4) AS gap_2 FROM s GROUP BY model""")
def stage_gaps(t):
    w = t("orders").groupBy(F.col("o_orderpriority").alias("model")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return w.select("model", F.round("F", 4).alias("plain"), F.round(F.col("O") - F.col("F"), 4).alias("gap_1"), F.round(F.col("P") - F.col("O"), 4).alias("gap_2"))


@query("""WITH g AS (SELECT item_id, unnest(list_transform(range(1, length(text) - 1), lambda i: lower(substr(text, i, 3)))) AS w FROM benchmark WHERE length(text) >= 3), p AS (SELECT item_id, w, count(*) AS tf FROM g GROUP BY ALL),
d AS (SELECT w, count(*) AS df FROM p GROUP BY w), n AS (SELECT count(DISTINCT item_id) AS n FROM p), x AS (SELECT item_id, p.w, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM p JOIN d USING (w), n)
SELECT item_id, count(*) AS grams, round(sqrt(sum(x * x)), 6) AS length FROM x GROUP BY item_id""")
def character_tfidf(t):
    """Runs of three characters; texts of under three have none."""
    grams = F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.lower(F.substring(F.col("text"), i, F.lit(3))))
    p = t("benchmark").filter("length(text) >= 3").select("item_id", F.explode(grams).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("tf"))
    n = p.select("item_id").distinct().count()
    x = p.join(p.groupBy("w").agg(F.count("*").alias("df")), "w").withColumn("x", (1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    return x.groupBy("item_id").agg(F.count("*").alias("grams"), F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("length"))


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS t FROM lineitem), seed AS (SELECT t FROM p WHERE e IN (1, 2, 3)), n AS (SELECT e, count(*) AS n FROM p GROUP BY e),
c AS (SELECT e, count(*) AS shared FROM p JOIN (SELECT DISTINCT t FROM seed) USING (t) WHERE e NOT IN (1, 2, 3) GROUP BY e)
SELECT e, round(greatest(shared / n, 1e-6) * greatest(n / (SELECT count(*) FROM p), 1e-6), 9) AS score FROM c JOIN n USING (e)
QUALIFY row_number() OVER (ORDER BY round(greatest(shared / n, 1e-6) * greatest(n / (SELECT count(*) FROM p), 1e-6), 9) DESC, e) <= 10""")
def entity_rank(t):
    """Candidates by a product of floored probabilities: shared with the seeds, and prior."""
    p = t("lineitem").select(F.col("l_suppkey").alias("e"), F.col("l_partkey").alias("t")).distinct()
    total = p.count()
    seeds = p.filter(F.col("e").isin(1, 2, 3)).select("t").distinct()
    c = p.filter(~F.col("e").isin(1, 2, 3)).join(seeds, "t").groupBy("e").agg(F.count("*").alias("shared")).join(p.groupBy("e").agg(F.count("*").alias("n")), "e")
    floor = lambda x: F.greatest(x, F.lit(1e-6))
    s = c.select("e", F.round(floor(F.col("shared") / F.col("n")) * floor(F.col("n") / F.lit(total)), 9).alias("score"))
    return s.orderBy(F.col("score").desc(), "e").limit(10)


@query("""WITH b AS (SELECT l_suppkey % 6 AS h, l_partkey AS v FROM lineitem), x AS (SELECT DISTINCT h, v FROM b), c AS (SELECT p.h AS q, r.h AS c, count(*) AS s FROM x p JOIN x r ON p.v = r.v AND p.h <> r.h GROUP BY ALL)
SELECT q, c, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS rank FROM c QUALIFY rank <= 3""")
def header_rank(t):
    x = t("lineitem").select((F.col("l_suppkey") % 6).alias("h"), F.col("l_partkey").alias("v")).distinct()
    c = x.withColumnRenamed("h", "q").join(x.withColumnRenamed("h", "c"), "v").filter("q <> c").groupBy("q", "c").agg(F.count("*").alias("s"))
    return L.top_k(c, ["q"], 3, F.col("s").desc(), F.col("c")).withColumn("rank", F.col("rank").cast("long"))

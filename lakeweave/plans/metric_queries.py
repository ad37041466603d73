"""Retrieval, classification, regression and clustering metrics, and chance baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.functions import metrics as M

from .registry import query
from .vector_queries import TOP_SQL, top

RANKED_SQL = f"""{TOP_SQL}, gt AS (SELECT a.id AS qid, b.id AS cid FROM e a JOIN e b ON a.label + 1 = b.label AND b.id % 7 = 0 WHERE a.id % 50 = 0),
n AS (SELECT qid, count(*) AS n_gt FROM gt GROUP BY qid),
r0 AS (SELECT t.qid, t.cid, t.rank, CASE WHEN gt.qid IS NULL THEN 0 ELSE 1 END AS rel FROM top t LEFT JOIN gt ON gt.qid = t.qid AND gt.cid = t.cid),
r1 AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS hits, count(*) OVER (PARTITION BY qid) AS n_results FROM r0),
r AS (SELECT n.qid, n_gt, cid, rank, rel, hits, n_results FROM n LEFT JOIN r1 USING (qid))"""


def ranked(t):
    """Vectors of the next label whose id is a multiple of 7 are the truth."""
    e = t("embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), (F.col("label") + 1).alias("l"))
    gt = q.join(e.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("cid"), F.col("label").alias("l")), "l")
    return M.ranked(top(t), gt)


def _q(k):
    return f"q AS (SELECT qid, coalesce(sum(rel) FILTER (rank <= {k}), 0) AS h, max(n_gt) AS g, coalesce(max(n_results), 0) AS n FROM r GROUP BY qid)"


@query(f"""WITH {RANKED_SQL}, {_q(10)}, s AS (SELECT coalesce(h / nullif(least(10, n), 0), 0) AS p, h / g AS c FROM q)
SELECT 10 AS k, round(avg(p), 6) AS precision, round(avg(c), 6) AS recall, round(avg(coalesce(2 * p * c / nullif(p + c, 0), 0)), 6) AS f1 FROM s""")
def join_pr_f1_at_k(t):
    return M.join_prf_at_k(ranked(t), 10)


@query(f"WITH {RANKED_SQL} SELECT qid, round(coalesce(sum(hits / rank * rel), 0) / max(n_gt), 6) AS ap FROM r GROUP BY qid")
def join_average_precision(t):
    return M.average_precision(ranked(t))


@query(f"""WITH {RANKED_SQL}, ks AS (SELECT unnest(range(1, 11)) AS k), h AS (SELECT qid, k, coalesce(sum(rel) FILTER (rank <= k), 0) AS h FROM r, ks GROUP BY ALL),
m AS (SELECT k, avg(h / k) AS x FROM h GROUP BY k) SELECT k, round(x, 6) AS precision, round(avg(x) OVER (ORDER BY k), 6) AS map FROM m""")
def union_map_mean_precision(t):
    return M.union_map(ranked(t), 10)


@query(f"WITH {RANKED_SQL}, {_q(5)} SELECT round(sum(h) / (count(*) * 5), 6) AS precision, count(*) AS n_queries FROM q WHERE g >= 5")
def micro_precision_at_k(t):
    return M.micro_precision(ranked(t), 5)


@query(f"""WITH {RANKED_SQL}, q AS (SELECT qid, min(rank) FILTER (rel = 1) AS a FROM r GROUP BY qid)
SELECT round(avg(CASE WHEN a <= 1 THEN 1 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN a <= 10 THEN 1 ELSE 0 END), 6) AS recall_10,
round(avg(coalesce(1 / a, 0)), 6) AS mrr, round(avg(coalesce(1 / log2(a + 1), 0)), 6) AS ndcg FROM q""")
def recall_mrr_ndcg(t):
    return M.first_hit(ranked(t), [1, 10])


@query(f"""WITH {TOP_SQL}, n AS (SELECT count(*) AS n FROM e WHERE id % 50 = 0), p2 AS (SELECT qid, cid, cgroup - qgroup = 1 AS rel, row_number() OVER (ORDER BY sim DESC, qid, cid) AS r FROM top)
SELECT count(*) AS n_gt, count(*) FILTER (rel) AS hits, round(count(*) FILTER (rel) / count(*), 6) AS recall FROM p2, n WHERE r <= n""")
def recall_at_gt(t):
    n = t("embeddings").filter("vec_id % 50 = 0").count()
    best = top(t).orderBy(F.col("sim").desc(), "qid", "cid").limit(n)
    rel = F.count_if(F.col("cgroup") - F.col("qgroup") == 1)
    return best.agg(F.count("*").alias("n_gt"), rel.alias("hits"), F.round(rel / F.count("*"), 6).alias("recall"))


_PRED = "l AS (SELECT quality AS y, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS p, doc_id, toxic FROM labels)"


def predicted(t):
    return t("labels").select(F.col("quality").alias("y"), F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("p"), "doc_id", "toxic")


@query(f"""WITH {_PRED}, c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p <> 1) AS fn, avg((y = p)::INT) AS acc FROM l)
SELECT round(acc, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def clf_metrics(t):
    return M.binary(predicted(t), "y", "p")


_CONF = f"""{_PRED}, k AS (SELECT DISTINCT y AS c FROM l UNION SELECT DISTINCT p FROM l),
f AS (SELECT c, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y <> c AND p = c) AS fp, count(*) FILTER (y = c AND p <> c) AS fn FROM k, l GROUP BY c),
g AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM f)"""


@query(f"WITH {_CONF} SELECT round(avg(f1), 6) AS f1 FROM g")
def f1_macro(t):
    return M.f1_macro(predicted(t), "y", "p")


@query(f"WITH {_CONF} SELECT round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS f1 FROM g")
def f1_weighted(t):
    return M.f1_weighted(predicted(t), "y", "p")


@query(f"WITH {_CONF} SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM g")
def f1_micro(t):
    return M.f1_micro(predicted(t), "y", "p")


@query("""WITH l AS (SELECT l_extendedprice AS y, l_quantity * 1500.0::DOUBLE AS p FROM lineitem), a AS (SELECT avg((y - p) * (y - p)) AS m, avg(abs(y - p)) AS mae, var_pop(y) AS v FROM l)
SELECT round(m, 4) AS mse, round(sqrt(m), 4) AS rmse, round(mae, 4) AS mae, round(1 - m / v, 6) AS r2 FROM a""")
def regression_metrics(t):
    return M.regression(t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p")), "y", "p")


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@query(f"SELECT round(corr(a, b), 6) AS r FROM (SELECT {_RANK.format(c='l_quantity')} AS a, {_RANK.format(c='l_extendedprice')} AS b FROM lineitem)")
def spearman(t):
    return M.spearman(t("lineitem"), "l_quantity", "l_extendedprice")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pearson(t):
    return M.pearson(t("lineitem"), "l_quantity", "l_extendedprice")


@query(f"""WITH l AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, {_RANK.format(c='s')} AS r FROM l),
a AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n, sum(r) FILTER (y = 1) AS s FROM r) SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS auroc FROM a""")
def auroc(t):
    return M.auroc(t("labels").join(t("documents"), "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").alias("s")), "y", "s")


@query("""WITH l AS (SELECT quality AS y, n_chars::DOUBLE AS s FROM labels JOIN documents USING (doc_id)), d AS (SELECT DISTINCT s FROM l),
c AS (SELECT coalesce((s + lag(s) OVER (ORDER BY s)) / 2, s - 0.01) AS t FROM d),
g AS (SELECT t, count(*) FILTER (s >= t AND y = 1) AS tp, count(*) FILTER (s >= t) AS said, sum(y) AS p FROM c, l GROUP BY t)
SELECT round(t, 6) AS threshold, round(2 * tp / (said + p), 6) AS f1 FROM g ORDER BY round(2 * tp / (said + p), 6) DESC, round(t, 6) LIMIT 1""")
def threshold_probe(t):
    return M.threshold_probe(t("labels").join(t("documents"), "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("s")), "y", "s")


_CL = "x AS (SELECT source AS c, lang AS l FROM documents), k AS (SELECT c, l, count(*) AS n FROM x GROUP BY ALL)"


@query(f"WITH {_CL} SELECT round(sum(m) / sum(n), 6) AS purity FROM (SELECT c, max(n) AS m, sum(n) AS n FROM k GROUP BY c)")
def purity(t):
    return M.purity(t("documents"), "source", "lang")


@query(f"""WITH {_CL}, t AS (SELECT sum(n)::DOUBLE AS t FROM k), a AS (SELECT -sum(m / t * ln(m / t)) AS h FROM (SELECT sum(n) AS m FROM k GROUP BY c), t),
b AS (SELECT -sum(m / t * ln(m / t)) AS h FROM (SELECT sum(n) AS m FROM k GROUP BY l), t), j AS (SELECT -sum(n / t * ln(n / t)) AS h FROM k, t)
SELECT round((a.h + b.h - j.h) / ((a.h + b.h) / 2), 6) AS nmi FROM a, b, j""")
def nmi(t):
    return M.nmi(t("documents"), "source", "lang")


@query(f"""WITH {_CL}, i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n)::DOUBLE AS n FROM k), a AS (SELECT sum(m * (m - 1) / 2) AS a FROM (SELECT sum(n) AS m FROM k GROUP BY c)),
b AS (SELECT sum(m * (m - 1) / 2) AS b FROM (SELECT sum(n) AS m FROM k GROUP BY l)), e AS (SELECT i, a, b, a * b / (n * (n - 1) / 2) AS e FROM i, a, b)
SELECT round((i - e) / ((a + b) / 2 - e), 6) AS ari FROM e""")
def adjusted_rand(t):
    return M.adjusted_rand(t("documents"), "source", "lang")


@query("""WITH m AS (SELECT quality AS c FROM labels WHERE doc_id % 2 = 0 GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1)
SELECT c AS majority, round(avg((quality = c)::INT), 6) AS accuracy FROM labels, m WHERE doc_id % 2 = 1 GROUP BY c""")
def majority_baseline(t):
    c = t("labels").filter("doc_id % 2 = 0").groupBy("quality").count().orderBy(F.col("count").desc(), "quality").first()[0]
    return t("labels").filter("doc_id % 2 = 1").agg(F.lit(c).alias("majority"), F.round(F.avg((F.col("quality") == F.lit(c)).cast("int")), 6).alias("accuracy"))


@query("""WITH m AS (SELECT avg(l_extendedprice) AS c FROM lineitem WHERE l_orderkey % 2 = 0), a AS (SELECT avg((l_extendedprice - c) * (l_extendedprice - c)) AS m, var_pop(l_extendedprice) AS v FROM lineitem, m WHERE l_orderkey % 2 = 1)
SELECT round(m, 2) AS mse, round(1 - m / v, 6) AS r2 FROM a""")
def mean_baseline(t):
    c = t("lineitem").filter("l_orderkey % 2 = 0").agg(F.avg("l_extendedprice")).first()[0]
    held = t("lineitem").filter("l_orderkey % 2 = 1").select(F.col("l_extendedprice").alias("y"), F.lit(c).alias("p"))
    return M.regression(held, "y", "p").select(F.round("mse", 2).alias("mse"), "r2")


@query("""WITH n AS (SELECT c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1) SELECT g, round(list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / i)) / n, 6) AS mrr,
round(least(10, n) / n, 6) AS hit FROM n""")
def chance_topk(t):
    n = t("customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.count("*").alias("n"))
    harmonic = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.lit(10).cast("long"), F.col("n"))), F.lit(0.0), lambda s, i: s + 1 / i)
    return n.select("g", F.round(harmonic / F.col("n"), 6).alias("mrr"), F.round(F.least(F.lit(10), F.col("n")) / F.col("n"), 6).alias("hit"))


@query("""WITH p AS (SELECT c_nationkey % 5 AS g, c_custkey AS k FROM customer WHERE c_custkey % 3 < 2), y AS (SELECT c_nationkey % 5 AS g, c_custkey AS k FROM customer WHERE c_custkey % 2 = 0),
s AS (SELECT g, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a) AS np, count(*) FILTER (b) AS ny FROM (SELECT g, k, bool_or(a) AS a, bool_or(b) AS b FROM
(SELECT g, k, true AS a, false AS b FROM p UNION ALL SELECT g, k, false, true FROM y) GROUP BY g, k) GROUP BY g)
SELECT round(sum(tp) / sum(np), 6) AS micro_p, round(sum(tp) / sum(ny), 6) AS micro_r, round(2 * sum(tp) / (sum(np) + sum(ny)), 6) AS micro_f1, round(avg(2 * tp / (np + ny)), 6) AS macro_f1 FROM s""")
def prf_micro_macro(t):
    c = t("customer").select((F.col("c_nationkey") % 5).alias("g"), F.col("c_custkey").alias("k"))
    p = c.filter("k % 3 < 2").withColumn("a", F.lit(1))
    y = c.filter("k % 2 = 0").withColumn("b", F.lit(1))
    s = p.join(y, ["g", "k"], "full").groupBy("g").agg(F.count(F.col("a") + F.col("b")).alias("tp"), F.count("a").alias("np"), F.count("b").alias("ny"))
    r = lambda c: F.round(c, 6)
    return s.agg(
        r(F.sum("tp") / F.sum("np")).alias("micro_p"), r(F.sum("tp") / F.sum("ny")).alias("micro_r"), r(2 * F.sum("tp") / (F.sum("np") + F.sum("ny"))).alias("micro_f1"),
        r(F.avg(2 * F.col("tp") / (F.col("np") + F.col("ny")))).alias("macro_f1"),
    )

"""Queries over the embeddings table: vectors are columns, labels are tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lakeweave.functions import vectors as V
from lakeweave.operators import ranks
from lakeweave.operators import vector_blocks as B
from lakeweave.operators import vector_join as J

from .registry import query

E_SQL = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"
PAIRS_SQL = f"""{E_SQL}, p AS MATERIALIZED (
  SELECT a.id AS qid, a.label AS qgroup, b.id AS cid, b.label AS cgroup, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS sim
  FROM e a JOIN e b ON a.label <> b.label WHERE a.id % 50 = 0)"""
TOP_SQL = f"""{PAIRS_SQL}, top AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS rank FROM p QUALIFY rank <= 30)"""


def sides(t, few=True):
    """Queries and lake. The stated queries are the ids divisible by 50."""
    e = t("embeddings")
    q = e.filter("vec_id % 50 = 0") if few else e
    return q.select(F.col("vec_id").alias("qid"), F.col("label").alias("qgroup"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("cid"), F.col("label").alias("cgroup"), F.col("embedding").alias("v"))


def top(t, k=30):
    return J.cosine_join(*sides(t), k=k)


@query(f"WITH {TOP_SQL} SELECT qid, cid, cgroup, sim, rank FROM top")
def vector_column_join_topk(t):
    return top(t).select("qid", "cid", "cgroup", "sim", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {PAIRS_SQL} SELECT qid, cid, sim FROM p WHERE sim >= 0.3")
def vector_join_threshold(t):
    return J.cosine_join(*sides(t), threshold=0.3).select("qid", "cid", "sim")


def _roll_up(how, agg, order):
    @query(
        f"""WITH {TOP_SQL}, g AS (SELECT qid, cgroup, count(*) AS matches, round({agg}(sim), 10) AS score FROM top GROUP BY qid, cgroup)
        SELECT qid, cgroup, matches, score, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM g QUALIFY rank <= 5""",
        name=f"table_rollup_{how}",
    )
    def run(t):
        return J.roll_up(top(t), how, 5).withColumn("rank", F.col("rank").cast("long"))


for _how, _agg, _order in (("max", "max", "score DESC, cgroup"), ("mean", "avg", "score DESC, cgroup"), ("sum", "sum", "score DESC, cgroup"), ("count_then_sum", "sum", "matches DESC, score DESC, cgroup")):
    _roll_up(_how, _agg, _order)


@query(f"""WITH {TOP_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY qid, cgroup ORDER BY rank) AS r FROM top),
g AS (SELECT cgroup, count(*) AS matches, round(sum(1 - sim), 6) AS distance FROM f WHERE r = 1 GROUP BY cgroup)
SELECT cgroup, matches, distance, row_number() OVER (ORDER BY matches DESC, distance, cgroup) AS rank FROM g""")
def first_match_per_table_rank(t):
    first = J.top_k(top(t), ["qid", "cgroup"], 1, F.col("rank"), name="r")
    g = first.groupBy("cgroup").agg(F.count("*").alias("matches"), F.round(F.sum(1 - F.col("sim")), 6).alias("distance"))
    g = g.withColumn("order", F.struct((-F.col("matches")).alias("m"), "distance", "cgroup"))
    return ranks.numbered(g, "order", "before").select("cgroup", "matches", "distance", (F.col("before") + 1).alias("rank"))


def _table_vector(how, agg):
    @query(
        f"""WITH {E_SQL}, c AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
        g AS (SELECT label, pos, {agg}(x) AS x FROM c GROUP BY label, pos)
        SELECT label, list(round(x, 6) + 0.0 ORDER BY pos) AS v FROM g GROUP BY label""",
        name=f"table_vector_{how}",
    )
    def run(t):
        return V.aggregate_vectors(t("embeddings"), "label", "embedding", how).select("label", V.rounded(F.col("embedding")).alias("v"))


for _how, _agg in (("mean", "avg"), ("sum", "sum"), ("max", "max"), ("min", "min")):
    _table_vector(_how, _agg)

UNIT_SQL = "list_transform({v}, lambda x: CASE WHEN sqrt(list_dot_product({v}, {v})) = 0 THEN x ELSE x / sqrt(list_dot_product({v}, {v})) END)"


@query(f"""WITH {E_SQL}, u AS (SELECT label, {UNIT_SQL.format(v="v")} AS v FROM e),
c AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM u), g AS (SELECT label, pos, avg(x) AS x FROM c GROUP BY label, pos),
m AS (SELECT label, list(x ORDER BY pos) AS v FROM g GROUP BY label), n AS (SELECT label, {UNIT_SQL.format(v="v")} AS v FROM m)
SELECT label, list_transform(v, lambda x: round(x, 6) + 0.0) AS v FROM n""")
def table_vector_l2mean(t):
    unit = t("embeddings").select("label", V.l2_normalize(F.col("embedding")).alias("v"))
    return V.aggregate_vectors(unit, "label", "v").select("label", V.rounded(V.l2_normalize(F.col("v"))).alias("v"))


def _pair(name, how, expr):
    @query(
        f"""WITH {E_SQL} SELECT a.id AS a, b.id AS b, list_transform({expr}, lambda x: round(x, 6) + 0.0) AS v
        FROM e a JOIN e b ON b.id = a.id + 1""",
        name=name,
    )
    def run(t):
        e = t("embeddings")
        b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("w"))
        both = e.select(F.col("vec_id").alias("a"), "embedding").join(b, "a")
        return both.select("a", "b", V.rounded(V.combine(F.col("embedding"), F.col("w"), how, 0.3)).alias("v"))


_ZIP = "list_transform(list_zip(a.v, b.v), lambda z: {})"
for _name, _how, _x in (
    ("hybrid_add", "add", _ZIP.format("z[1] + z[2]")),
    ("hybrid_concat", "concat", "list_concat(a.v, b.v)"),
    ("hybrid_weighted", "weighted", _ZIP.format("z[1] * 0.3::DOUBLE + z[2] * 0.7::DOUBLE")),
    ("pair_combine_diff", "abs_diff", _ZIP.format("abs(z[1] - z[2])")),
    ("pair_combine_multiply", "multiply", _ZIP.format("z[1] * z[2]")),
):
    _pair(_name, _how, _x)

TWO_SQL = f"""{E_SQL}, p AS MATERIALIZED (SELECT a.id AS qid, b.id AS cid, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS sim
  FROM e a JOIN e b ON a.label % 2 = 0 AND b.label = a.label + 1)"""


def two_groups(t):
    """The vectors of tables 2n and of tables 2n + 1: the row-matching operators work on pairs of tables."""
    q, c = sides(t, few=False)
    return q.filter("qgroup % 2 = 0").select("qid", F.col("qgroup").alias("pair"), "v"), c.select("cid", (F.col("cgroup") - 1).alias("pair"), "v")


CSLS_SQL = f"""{TWO_SQL}, l AS (SELECT qid, avg(sim) AS m FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS r FROM p) WHERE r <= 5 GROUP BY qid),
c AS (SELECT cid, avg(sim) AS m FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY sim DESC, qid) AS r FROM p) WHERE r <= 5 GROUP BY cid),
s AS MATERIALIZED (SELECT p.*, round(2 * sim - l.m - c.m, 6) AS csls FROM p JOIN l USING (qid) JOIN c USING (cid))"""


@query(f"WITH {CSLS_SQL} SELECT qid, cid, sim, csls FROM s")
def csls_scores(t):
    return B.csls(*two_groups(t), 5)


@query(f"""WITH {CSLS_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY csls DESC, cid) AS a, row_number() OVER (PARTITION BY cid ORDER BY csls DESC, qid) AS b FROM s)
SELECT qid, cid, csls FROM best WHERE a = 1 AND b = 1""")
def mutual_nn_one_round(t):
    return B.mutual_csls(*two_groups(t), 5)


@query(f"""WITH {TWO_SQL}, m AS (SELECT qid, sim - max(sim) OVER (PARTITION BY qid) AS x FROM p),
s AS (SELECT qid, sum(exp(x)) AS z, sum(exp(x) * x) AS y, count(*) AS n FROM m GROUP BY qid)
SELECT qid, CASE WHEN n <= 1 THEN 0.0 ELSE round((ln(z) - y / z) / ln(n), 6) END AS entropy FROM s""")
def neighbourhood_entropy(t):
    return B.entropy(B.statistics(*two_groups(t), 1)).select(F.col("id").alias("qid"), "entropy")


@query(f"""WITH {TWO_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS r FROM p),
a AS (SELECT qid, max(cid) FILTER (r = 1) AS best, max(sim) FILTER (r = 1) AS s1, max(sim) FILTER (r = 2) AS s2, avg(sim) AS m, stddev_pop(sim) AS d FROM r GROUP BY qid)
SELECT qid, best, CASE WHEN d = 0 THEN 0.0 ELSE round((s1 - m) / d, 6) END AS z, CASE WHEN d = 0 THEN 0.0 ELSE round((s1 - s2) / d, 6) END AS margin FROM a""")
def match_diagnostics(t):
    return B.diagnostics(B.statistics(*two_groups(t), 2)).select(F.col("id").alias("qid"), "best", "z", "margin")


@query(f"""WITH {TWO_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS r, row_number() OVER (PARTITION BY cid ORDER BY sim DESC, qid) AS s FROM p),
a AS (SELECT qid, max(sim) FILTER (r = 1) AS s1, max(sim) FILTER (r = 2) AS s2, avg(sim) AS m, stddev_pop(sim) AS d FROM l GROUP BY qid),
b AS (SELECT cid, max(sim) FILTER (s = 1) AS s1, max(sim) FILTER (s = 2) AS s2, avg(sim) AS m, stddev_pop(sim) AS d FROM l GROUP BY cid),
ea AS (SELECT qid, sum(exp(x)) AS z, sum(exp(x) * x) AS y, count(*) AS n FROM (SELECT qid, (sim - max(sim) OVER (PARTITION BY qid)) / stddev_pop(sim) OVER (PARTITION BY qid) AS x FROM p) GROUP BY qid),
eb AS (SELECT cid, sum(exp(x)) AS z, sum(exp(x) * x) AS y, count(*) AS n FROM (SELECT cid, (sim - max(sim) OVER (PARTITION BY cid)) / stddev_pop(sim) OVER (PARTITION BY cid) AS x FROM p) GROUP BY cid)
SELECT l.qid, l.cid, l.sim FROM l JOIN a USING (qid) JOIN b USING (cid) JOIN ea USING (qid) JOIN eb USING (cid) WHERE r = 1 AND s = 1 AND l.sim >= 0.1
AND round((a.s1 - a.m) / a.d, 6) >= 2 AND round((b.s1 - b.m) / b.d, 6) >= 2 AND round((a.s1 - a.s2) / a.d, 6) >= 0.05 AND round((b.s1 - b.s2) / b.d, 6) >= 0.05
AND round((ln(ea.z) - ea.y / ea.z) / ln(ea.n), 6) <= 0.92 AND round((ln(eb.z) - eb.y / eb.z) / ln(eb.n), 6) <= 0.92""")
def accepted_matches(t):
    return B.accepted(*two_groups(t), 0.1, 2.0, 0.05, 0.92)


PLANES = [[[math.sin(1.7 * (d + 1) * (b + 1) + 3.1 * (k + 1)) for d in range(64)] for b in range(6)] for k in range(4)]


def _lsh_sql():
    bits = [f"SELECT id, {k} AS t, " + " + ".join(f"CASE WHEN list_dot_product(v, {[float(x) for x in p]}::DOUBLE[]) > 0 THEN {1 << b} ELSE 0 END" for b, p in enumerate(t)) + " AS code FROM e" for k, t in enumerate(PLANES)]
    return f"WITH {E_SQL}, c AS ({' UNION ALL '.join(bits)}) SELECT a.id AS a, b.id AS b, count(*) AS hits FROM c a JOIN c b ON a.t = b.t AND a.code = b.code AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) >= 2"


@query(_lsh_sql())
def lsh_candidates(t):
    return J.lsh_candidates(t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), PLANES)

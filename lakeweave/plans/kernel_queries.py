"""Matchings, clusters, anchors, enrichment and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.functions import vectors as V
from lakeweave.operators import enrichment as E
from lakeweave.operators import graph as G
from lakeweave.operators import matching as M
from lakeweave.operators import models
from lakeweave.operators import vector_join as J
from lakeweave.operators.near_pairs import near_pairs, row_cosines

from .lake_queries import CELLS_SQL  # noqa: F401
from .registry import query
from .vector_queries import E_SQL, sides


def edges(t, least=-2.0, columns=8):
    """Tables are groups of so many vectors with neighbouring ids; pairs are tables 2n and 2n + 1."""
    e = t("embeddings").filter("embedding IS NOT NULL").select("vec_id", F.floor(F.col("vec_id") / columns).alias("tab"), V.doubles(F.col("embedding")).alias("v"))
    q = e.filter("tab % 2 = 0").select((F.col("tab") + 1).alias("tb"), F.col("tab").alias("ta"), F.col("vec_id").alias("a"), F.col("v").alias("va"))
    c = e.filter("tab % 2 = 1").select(F.col("tab").alias("tb"), F.col("vec_id").alias("b"), F.col("v").alias("vb"))
    p = row_cosines(q.join(c, "tb").select("ta", "tb", "a", "b", "va", "vb"), "va", "vb")
    return p.filter(F.col("sim") >= least)


def table_sizes(t, columns=8):
    """(ta, tb, na, nb): the pairs of tables that have both, and their numbers of columns."""
    n = t("embeddings").filter("embedding IS NOT NULL").groupBy(F.floor(F.col("vec_id") / columns).alias("tab")).agg(F.count("*").alias("n"))
    a = n.filter("tab % 2 = 0").select(F.col("tab").alias("ta"), (F.col("tab") + 1).alias("tb"), F.col("n").alias("na"))
    return a.join(n.select(F.col("tab").alias("tb"), F.col("n").alias("nb")), "tb").select("ta", "tb", "na", "nb")


@query()
def assignment_score(t):
    return M.match_tables(edges(t), table_sizes(t), 0.1)


@query()
def assignment_pairs(t):
    return M.align_columns(edges(t))


#: All ways to pair four columns with four, one by one.
_FOUR_SQL = f"""WITH {E_SQL}, p AS MATERIALIZED (SELECT a.id // 4 AS ta, b.id // 4 AS tb, a.id % 4 AS i, b.id % 4 AS j, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS sim
  FROM e a JOIN e b ON a.id // 4 % 2 = 0 AND b.id // 4 = a.id // 4 + 1), g AS (SELECT *, CASE WHEN sim >= 0.1 THEN sim ELSE 0 END AS gain FROM p)
SELECT w.ta, w.tb, round(max(w.gain + x.gain + y.gain + z.gain), 6) AS matched FROM g w JOIN g x USING (ta, tb) JOIN g y USING (ta, tb) JOIN g z USING (ta, tb)
WHERE w.i = 0 AND x.i = 1 AND y.i = 2 AND z.i = 3 AND len(list_distinct([w.j, x.j, y.j, z.j])) = 4 GROUP BY w.ta, w.tb"""


def _matched(t, **how):
    pairs = M.align_columns(edges(t, columns=4), threshold=0.1, **how).groupBy("ta", "tb").agg(F.sum("sim").alias("s"))
    out = table_sizes(t, 4).filter("na = 4 and nb = 4").join(pairs, ["ta", "tb"], "left")
    return out.select("ta", "tb", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("matched"))


@query(_FOUR_SQL)
def assignment_of_four(t):
    """Pairs of tables as small dense matrices."""
    return _matched(t)


@query(_FOUR_SQL)
def assignment_auction(t):
    """The same by an auction over all pairs of tables at once."""
    return _matched(t, most=0)


def _greedy_sql() -> str:
    """Best edge first, four times, and bounds of the matching over edges above 0.1."""
    text = _FOUR_SQL[: _FOUR_SQL.index(", g AS")] + """, k AS (SELECT *, row_number() OVER (PARTITION BY ta, tb ORDER BY sim DESC, i, j) AS r FROM p WHERE sim > 0.1), g0 AS (SELECT * FROM k)"""
    for n in range(4):
        text += f""", t{n} AS (SELECT * FROM g{n} QUALIFY row_number() OVER (PARTITION BY ta, tb ORDER BY r) = 1),
        g{n + 1} AS (SELECT g.* FROM g{n} g JOIN t{n} t USING (ta, tb) WHERE g.i <> t.i AND g.j <> t.j)"""
    return text + """, low AS (SELECT ta, tb, sum(sim) AS lower FROM (""" + " UNION ALL ".join(f"SELECT ta, tb, sim FROM t{n}" for n in range(4)) + """) GROUP BY ta, tb),
    f AS (SELECT *, min(r) OVER (PARTITION BY ta, tb, i) AS fi, min(r) OVER (PARTITION BY ta, tb, j) AS fj FROM k),
    w AS (SELECT ta, tb, count(DISTINCT i) AS wi, count(DISTINCT j) AS wj FROM k GROUP BY ta, tb),
    s AS (SELECT f.*, sum((r = fi)::INT) OVER o AS rows_before, sum((r = fj)::INT) OVER o AS cols_before FROM f WINDOW o AS (PARTITION BY ta, tb ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    up AS (SELECT ta, tb, sum(sim) FILTER (coalesce(rows_before, 0) < wi AND coalesce(cols_before, 0) < wj) AS upper FROM s JOIN w USING (ta, tb) GROUP BY ta, tb)
    SELECT p.ta, p.tb, round(coalesce(any_value(lower), 0), 6) AS lower, round(coalesce(any_value(upper), 0), 6) AS upper FROM p LEFT JOIN low USING (ta, tb) LEFT JOIN up USING (ta, tb) GROUP BY p.ta, p.tb HAVING count(*) = 16"""


@query(_greedy_sql())
def bounds_of_four(t):
    """Greedy matching as the lower bound, and the upper bound, for pairs of tables of four columns."""
    out = M.match_tables(edges(t, columns=4), table_sizes(t, 4), 0.1)
    return out.join(table_sizes(t, 4).filter("na = 4 and nb = 4").select("ta", "tb"), ["ta", "tb"]).select("ta", "tb", "lower", "upper")


@query()
def greedy_match(t):
    return M.align_columns(edges(t), how="greedy")


@query()
def classify_table_pairs(t):
    return M.classify_pairs(M.align_columns(edges(t), threshold=0.15), table_sizes(t), 0.6, 0.2, 0.5, 0.2, 0.15)


_EDGES_SQL = f"""{E_SQL}, p AS MATERIALIZED (SELECT a.id // 8 AS ta, b.id // 8 AS tb, a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS sim
  FROM e a JOIN e b ON a.id // 8 % 2 = 0 AND b.id // 8 = a.id // 8 + 1),
n AS (SELECT x.id // 8 AS ta, count(*) AS na FROM e x GROUP BY 1), z AS (SELECT x.ta, y.ta AS tb, x.na, y.na AS nb FROM n x JOIN n y ON x.ta % 2 = 0 AND y.ta = x.ta + 1),
m AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r, row_number() OVER (PARTITION BY b ORDER BY sim DESC, a) AS s FROM p),
g AS (SELECT ta, tb, count(*) FILTER (sim >= 0.15) AS n, avg(sim) FILTER (sim >= 0.15) AS mean, max(sim) AS best, arg_min({{{{'a': a, 'b': b}}}}, {{{{'s': -sim, 'a': a, 'b': b}}}}) AS k FROM m WHERE r = 1 AND s = 1 GROUP BY ta, tb),
x AS (SELECT z.ta, z.tb, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean, coalesce(best, 0) AS best, k, coalesce(n, 0) / na AS ratio FROM z LEFT JOIN g USING (ta, tb)),
c AS (SELECT *, CASE WHEN ratio >= 0.4 AND mean >= 0.15 THEN 'union' WHEN ratio <= 0.3 AND best >= 0.2 AND n BETWEEN 1 AND 3 THEN 'join' ELSE 'none' END AS relation FROM x)""".replace("{{", "{").replace("}}", "}")


@query(f"""WITH {_EDGES_SQL} SELECT ta, tb, relation, round(CASE relation WHEN 'union' THEN least(ratio, mean) WHEN 'join' THEN best ELSE 1 - best END, 9) AS confidence,
CASE WHEN relation = 'join' THEN k.a END AS key_a, CASE WHEN relation = 'join' THEN k.b END AS key_b FROM c""")
def classify_mutual_pairs(t):
    """The rules on an alignment by mutual best columns."""
    pairs = edges(t)
    best = J.mutual_best(pairs.withColumnsRenamed({"a": "qid", "b": "cid"})).withColumnsRenamed({"qid": "a", "cid": "b"})
    return M.classify_pairs(best, table_sizes(t), 0.4, 0.15, 0.3, 0.2, 0.15)


def _reciprocal_sql(k: int, rounds: int, score: float, z: float, margin: float, entropy: float) -> str:
    text = f"""WITH {E_SQL}, l0 AS MATERIALIZED (SELECT a.id // 8 AS ta, b.id // 8 AS tb, a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS sim
    FROM e a JOIN e b ON a.id // 8 % 2 = 0 AND b.id // 8 = a.id // 8 + 1)"""
    for n in range(rounds):
        best = lambda by, other: f"(SELECT ta, tb, {by}, avg(sim) AS m FROM (SELECT * FROM l{n} QUALIFY row_number() OVER (PARTITION BY ta, tb, {by} ORDER BY sim DESC, {other}) <= {k}) GROUP BY ta, tb, {by})"  # noqa: B023, E731
        text += f", s{n} AS MATERIALIZED (SELECT l.*, round(2 * sim - x.m - y.m, 9) AS score FROM l{n} l JOIN {best('a', 'b')} x USING (ta, tb, a) JOIN {best('b', 'a')} y USING (ta, tb, b))"
        for by, other in (("a", "b"), ("b", "a")):
            text += f""", d{by}{n} AS (SELECT *, row_number() OVER (PARTITION BY ta, tb, {by} ORDER BY score DESC, {other}) AS r, count(*) OVER w AS n, avg(score) OVER w AS mean,
            CASE WHEN stddev_pop(score) OVER w < 1e-12 THEN 1.0 ELSE stddev_pop(score) OVER w END AS dev, max(score) OVER w AS s1 FROM s{n} WINDOW w AS (PARTITION BY ta, tb, {by})),
            o{by}{n} AS (SELECT ta, tb, {by}, max({other}) FILTER (r = 1) AS {other} FROM d{by}{n} GROUP BY ta, tb, {by}, n, mean, dev, s1
            HAVING round((s1 - mean) / dev, 6) >= {z} AND (n = 1 OR (round((s1 - max(score) FILTER (r = 2)) / dev, 6) >= {margin}
            AND round((ln(sum(exp((score - s1) / dev))) - sum(exp((score - s1) / dev) * (score - s1) / dev) / sum(exp((score - s1) / dev))) / ln(n), 6) <= {entropy})))"""
        text += f""", f{n} AS MATERIALIZED (SELECT ta, tb, a, b, sim, {n} AS turn FROM s{n} JOIN oa{n} USING (ta, tb, a, b) JOIN ob{n} USING (ta, tb, a, b) WHERE score >= {score}),
        l{n + 1} AS MATERIALIZED (SELECT * FROM l{n} l WHERE NOT EXISTS (FROM f{n} f WHERE f.ta = l.ta AND f.tb = l.tb AND (f.a = l.a OR f.b = l.b)))"""
    return text + " " + " UNION ALL ".join(f"SELECT ta, tb, a, b, sim, turn::INT AS turn FROM f{n}" for n in range(rounds))


@query(_reciprocal_sql(3, 4, -0.05, 1.2, 0.1, 0.95))
def reciprocal_multi_round(t):
    return M.reciprocal_join(edges(t), 3, 4, -0.05, 1.2, 0.1, 0.95, z_scores=True)


@query(_reciprocal_sql(3, 2, -9.0, 0.0, 0.0, 1.0))
def reciprocal_two_rounds(t):
    """No test but mutual best: later rounds take many pairs."""
    return M.reciprocal_join(edges(t), 3, 2, z_scores=True)


def similar(t, forest=False):
    q, c = sides(t, few=False)
    p = near_pairs(q.withColumn("qgroup", F.col("qid")), c.withColumn("cgroup", F.col("cid")), threshold=0.45, ordered=True, forest=forest)
    return p.select(F.col("qid").alias("a"), F.col("cid").alias("b"), F.col("score").alias("sim"))


def _checkpointed(t):
    from lakeweave.sources.writers import checkpoint_dir

    checkpoint_dir(t("region").sparkSession)


@query(f"""WITH RECURSIVE {E_SQL}, p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id < b.id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.45),
g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT DISTINCT a AS node, a AS reach FROM g UNION SELECT r.node, g.b FROM r JOIN g ON g.a = r.reach)
SELECT node, min(reach) AS comp FROM r GROUP BY node""")
def connected_components(t):
    _checkpointed(t)
    return G.components(similar(t, forest=True))


@query()
def capped_components(t):
    _checkpointed(t)
    return G.capped_components(similar(t), 5)


@query()
def anchor_select(t):
    p = t("part").groupBy("p_brand").agg(F.count("*").alias("rows"), F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"))
    keys = G.farthest_points(p, "p_brand", ["rows", "size", "price"], 5, ["rows"])
    return p.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], "n int, p_brand string")


@query("""WITH q AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer WHERE c_custkey % 3 = 0), u AS (SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 < 2),
e AS (SELECT * FROM q UNION ALL SELECT * FROM u WHERE lower(c_custkey::VARCHAR) NOT IN (SELECT lower(id::VARCHAR) FROM q)),
f AS (SELECT e.*, j.c_mktsegment FROM e LEFT JOIN customer j ON j.c_custkey = e.id AND j.c_custkey % 2 = 0),
a AS (SELECT v, count(*) AS x FROM (SELECT unnest([lower(id::VARCHAR), lower(name), lower(nation::VARCHAR), lower(c_mktsegment)]) AS v FROM f) WHERE v IS NOT NULL GROUP BY v),
b AS (SELECT v, count(*) AS y FROM (SELECT unnest([lower(c_custkey::VARCHAR), lower(c_name), lower(c_nationkey::VARCHAR), lower(c_mktsegment)]) AS v FROM customer) WHERE v IS NOT NULL GROUP BY v),
s AS (SELECT sum(least(coalesce(x, 0), coalesce(y, 0)))::BIGINT AS tp, sum(x) AS nx, sum(y) AS ny FROM a FULL JOIN b USING (v))
SELECT tp, round(tp / nx, 6) AS precision, round(tp / ny, 6) AS recall, round(2 * tp / (nx + ny), 6) AS f1 FROM s""")
def enrich_end_to_end(t):
    c = t("customer")
    q = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    out = E.enrich_table(q, c.filter("c_custkey % 3 < 2"), c.filter("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment"), {"id": "c_custkey", "name": "c_name", "nation": "c_nationkey"}, "id", "c_custkey")
    return E.cell_f1(out, c, ["id", "name", "nation", "c_mktsegment"], ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@query()
def probe_logistic(t):
    """A logistic head on vectors, regularisation swept on held-out rows; accuracy on the test rows."""
    e = t("embeddings").select("vec_id", F.col("embedding").alias("v"), (F.col("label") % 2).alias("y"))
    return models.logistic_probe(e, "v", "y", F.col("vec_id") % 5)


@query()
def probe_forest(t):
    e = t("embeddings").select("vec_id", F.col("embedding").alias("v"), (F.col("label") % 2).alias("y"))
    return models.forest_probe(e, "v", "y", F.col("vec_id") % 5, trees=20)


@query()
def probe_mlp(t):
    e = t("embeddings").select("vec_id", F.col("embedding").alias("v"), (F.col("label") % 2).alias("y"))
    return models.mlp_probe(e, "v", "y", F.col("vec_id") % 5, 64, 2, sweep=(16,))


@query()
def pruned_top_tables(t):
    """For each even table the three best odd ones among the ten tables next to it, with matchings only where bounds leave them open."""
    e = t("embeddings").filter("embedding IS NOT NULL").select("vec_id", F.floor(F.col("vec_id") / 8).alias("tab"), V.doubles(F.col("embedding")).alias("v"))
    q = e.filter("tab % 2 = 0").select(F.col("tab").alias("ta"), F.col("vec_id").alias("a"), F.col("v").alias("va"), F.explode(F.sequence(F.col("tab") - 9, F.col("tab") + 9, F.lit(2))).alias("tb"))
    p = q.join(e.select(F.col("tab").alias("tb"), F.col("vec_id").alias("b"), F.col("v").alias("vb")), "tb")
    _checkpointed(t)
    p = row_cosines(p.select("ta", "tb", "a", "b", "va", "vb"), "va", "vb").checkpoint()  # bounds, matchings and pairs are of the same edges
    return M.top_tables(p, p.select("ta", "tb").distinct(), 0.1, 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {E_SQL}, n AS (SELECT label, count(*) AS n FROM e GROUP BY label) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v) * 3 / least(x.n, y.n) + list_cosine_similarity(a.v, b.v), 6) AS score
FROM e a JOIN e b ON b.id = a.id + 1 JOIN n x ON x.label = a.label JOIN n y ON y.label = b.label""")
def mixed_scores(t):
    e, n = t("embeddings"), t("embeddings").groupBy("label").agg(F.count("*").alias("n"))
    e = e.join(n, "label").select("vec_id", "n", V.doubles(F.col("embedding")).alias("v"))
    both = e.select(F.col("vec_id").alias("a"), F.col("n").alias("na"), "v").join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("n").alias("nb"), F.col("v").alias("w")), "a")
    sim = V.cosine(F.col("v"), F.col("w"))
    return both.select("a", "b", F.round(M.mixed_score(3 * sim, F.col("na"), F.col("nb"), sim), 6).alias("score"))


@query()
def probe_ridge(t):
    p = t("part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.length("p_name").cast("double")).alias("v"), F.col("p_retailprice").alias("y"))
    return models.ridge_probe(p, "v", "y", F.col("p_partkey") % 5)

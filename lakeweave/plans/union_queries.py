"""Union search from columns to verified tables. Tables are groups of four vectors with neighbouring ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.operators import lsh, neighbour_graph
from lakeweave.operators import vector_join as J

from .registry import query
from .vector_queries import E_SQL, PLANES

_CODES = " UNION ALL ".join(
    f"SELECT id, tab, {k} AS t, " + " + ".join(f"CASE WHEN list_dot_product(v, {[float(x) for x in p]}::DOUBLE[]) > 0 THEN {1 << b} ELSE 0 END" for b, p in enumerate(planes)) + " AS code FROM w"
    for k, planes in enumerate(PLANES)
)


def _probe_sql(asked: str, k: int) -> str:
    """Bucket by bucket: a query's code or one that differs by one bit."""
    return f"""{E_SQL}, w AS MATERIALIZED (SELECT id, id // 4 AS tab, v FROM e), c AS MATERIALIZED ({_CODES}),
    h AS (SELECT q.id AS qid, c.id AS cid FROM c q JOIN c ON c.t = q.t AND bit_count(xor(c.code, q.code)) <= 1 WHERE {asked} GROUP BY q.id, c.id HAVING count(*) >= 2),
    d AS (SELECT h.qid, a.tab AS qgroup, h.cid, b.tab AS cgroup, round(list_dot_product(a.v, b.v), 6) + 0.0 AS dot FROM h JOIN w a ON a.id = h.qid JOIN w b ON b.id = h.cid WHERE a.tab <> b.tab),
    hits AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dot DESC, cid) AS rank FROM d QUALIFY rank <= {k})"""


def _columns(t):
    e = t("embeddings").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 4).alias("tab"), F.col("embedding").alias("v"))
    return e.select(F.col("id").alias("qid"), F.col("tab").alias("qgroup"), "v"), e.select(F.col("id").alias("cid"), F.col("tab").alias("cgroup"), "v")


@query(f"WITH {_probe_sql('q.id % 50 = 0', 10)} SELECT qid, cid, cgroup, dot, rank FROM hits")
def multi_probe_topk(t):
    q, c = _columns(t)
    return lsh.multi_probe(q.filter("qid % 50 = 0"), c, PLANES, 10).select("qid", "cid", "cgroup", "dot", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_probe_sql('true', 3)}, p AS (SELECT DISTINCT qgroup AS ta, cgroup AS tb FROM hits),
g AS MATERIALIZED (SELECT p.ta, p.tb, a.id % 4 AS i, b.id % 4 AS j, CASE WHEN round(list_cosine_similarity(a.v, b.v), 6) > 0.15 THEN round(list_cosine_similarity(a.v, b.v), 6) ELSE 0 END AS sim
  FROM p JOIN w a ON a.tab = p.ta JOIN w b ON b.tab = p.tb),
s AS (SELECT w.ta, w.tb, round(max(w.sim + x.sim + y.sim + z.sim), 6) AS score FROM g w JOIN g x USING (ta, tb) JOIN g y USING (ta, tb) JOIN g z USING (ta, tb)
  WHERE w.i = 0 AND x.i = 1 AND y.i = 2 AND z.i = 3 AND len(list_distinct([w.j, x.j, y.j, z.j])) = 4 GROUP BY w.ta, w.tb)
SELECT ta, tb, score, row_number() OVER (PARTITION BY ta ORDER BY score DESC, tb) AS rank FROM s QUALIFY rank <= 3""")
def union_search_topk(t):
    """Every table against the lake: columns by hashes, their tables, a matching of all columns of each pair."""
    q, c = _columns(t)
    hits = lsh.multi_probe(q, c, PLANES, 3)
    return lsh.union_search(q, c, hits, 0.15, 3).withColumn("rank", F.col("rank").cast("long"))


def _by_graph(t, k):
    e = t("embeddings").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    graph = neighbour_graph.build(e, 24)
    return e, neighbour_graph.search(graph, e, e.filter("id % 50 = 0").select(F.col("id").alias("qid"), "v"), k, 160)


@query()
def graph_topk(t):
    """The ten nearest vectors of the stated queries by a search of the neighbour graph."""
    return _by_graph(t, 10)[1].withColumn("rank", F.col("rank").cast("long"))


@query("SELECT count(*) AS queries, 10 * count(*) AS wanted, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def graph_recall(t):
    """Whether the graph finds nine of ten of the ten nearest by the exact join."""
    e, found = _by_graph(t, 10)
    q, c = (e.filter("id % 50 = 0"), e)
    exact = J.cosine_join(q.select(F.col("id").alias("qid"), F.col("id").alias("qgroup"), "v"), c.select(F.col("id").alias("cid"), F.col("id").alias("cgroup"), "v"), k=10)
    both = exact.select("qid", "cid").join(found.select("qid", "cid", F.lit(1).alias("hit")), ["qid", "cid"], "left")
    return both.agg(F.countDistinct("qid").alias("queries"), F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))

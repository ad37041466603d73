"""Ranking of labels, entities and cell values: orders are tables, suppliers entities, flags and states labels, priorities captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.operators import ranking as R
from lakeweave.operators.vector_join import top_k

from .registry import query

_SQL = """e AS MATERIALIZED (SELECT DISTINCT l_orderkey AS tab, l_suppkey AS entity FROM lineitem),
l AS MATERIALIZED (SELECT DISTINCT l_orderkey AS tab, 'r:' || l_returnflag AS label FROM lineitem UNION SELECT l_orderkey, 's:' || l_linestatus FROM lineitem),
c AS MATERIALIZED (SELECT tab, word, count(*) AS tf FROM (SELECT o_orderkey AS tab, unnest(string_split_regex(o_orderpriority, '[^A-Z]+')) AS word FROM orders) WHERE word <> '' GROUP BY ALL),
k AS (SELECT sum(tf)::DOUBLE AS whole FROM c), w AS (SELECT word, sum(tf) AS ctf FROM c GROUP BY word),
se AS (SELECT s_nationkey AS q, min(s_suppkey) AS entity FROM supplier GROUP BY s_nationkey), sl AS (SELECT q, CASE q % 2 WHEN 0 THEN 'r:A' ELSE 'r:R' END AS label FROM se UNION ALL SELECT q, 's:F' FROM se)"""


def _parts(t):
    lines, orders, near = t("lineitem"), t("orders"), t("supplier")
    e = lines.select(F.col("l_orderkey").alias("tab"), F.col("l_suppkey").alias("entity"))
    names = F.explode(F.array(F.concat(F.lit("r:"), "l_returnflag"), F.concat(F.lit("s:"), "l_linestatus")))
    labels = lines.select(F.col("l_orderkey").alias("tab"), names.alias("label"))
    words = orders.select(F.col("o_orderkey").alias("tab"), F.explode(F.split("o_orderpriority", "[^A-Z]+")).alias("word")).filter("word <> ''")
    seeds = near.groupBy(F.col("s_nationkey").alias("q")).agg(F.min("s_suppkey").alias("entity"))
    own = F.explode(F.array(F.when(F.col("q") % 2 == 0, "r:A").otherwise("r:R"), F.lit("s:F")))
    return e, labels, words, seeds, seeds.select("q", own.alias("label"))


@query(f"""WITH {_SQL}, ll AS (SELECT tab, sum(tf * ln(ctf / whole)) AS ll FROM c JOIN w USING (word), k GROUP BY tab),
a AS (SELECT q, tab, count(*) / 2 AS by_label FROM sl JOIN l USING (label) GROUP BY q, tab), b AS (SELECT q, tab, 1.0 AS by_entity FROM se JOIN e USING (entity)),
p AS (SELECT q, tab, greatest(coalesce(by_label, 0), 1e-6) * greatest(coalesce(by_entity, 0), 1e-6) * greatest(coalesce(exp(ll), 0), 1e-6) AS p FROM a FULL JOIN b USING (q, tab) LEFT JOIN ll USING (tab)),
n AS (SELECT tab, count(*) AS n FROM l GROUP BY tab)
SELECT q, label, round(sum(p / n), 6) AS score FROM p JOIN n USING (tab) JOIN l USING (tab) GROUP BY q, label""")
def label_rank(t):
    """Labels by the tables that share a supplier or a label with each nation's seeds, and the likelihood of their captions."""
    e, labels, words, seeds, own = _parts(t)
    every = words.groupBy("word").agg(F.count("*").alias("ctf"))
    share = every.join(every.agg(F.sum("ctf").alias("whole"))).select("word", F.log(F.col("ctf") / F.col("whole")).alias("x"))
    ll = words.join(share, "word").groupBy("tab").agg(F.sum("x").alias("ll"))
    return R.label_scores(labels, e, own, seeds, ll).select("q", "label", F.round("score", 6).alias("score"))


@query(f"""WITH {_SQL}, b AS (SELECT q, tab FROM se JOIN e USING (entity)), n AS (SELECT q, count(*) AS n FROM b GROUP BY q),
m AS (SELECT q, entity, count(*) AS m FROM b JOIN e USING (tab) WHERE (q, entity) NOT IN (FROM se) GROUP BY ALL), g AS MATERIALIZED (SELECT q, entity, 0.5 * m / n AS by_seeds FROM m JOIN n USING (q)),
x AS (SELECT entity, word, sum(tf) AS tf FROM e JOIN c USING (tab) GROUP BY ALL), y AS (SELECT entity, sum(tf) AS len FROM x GROUP BY entity),
s AS (SELECT q, entity, exp(sum(ln((coalesce(tf, 0) + 2000.0 * ctf / whole) / (len + 2000.0)))) AS by_caption FROM g JOIN w ON word IN ('NOT', 'LOW') JOIN y USING (entity) LEFT JOIN x USING (entity, word), k GROUP BY q, entity),
al AS (SELECT label, count(*) AS a, (SELECT count(*) FROM l) AS al FROM l GROUP BY label), le AS (SELECT entity, label, count(*) AS le FROM e JOIN l USING (tab) GROUP BY ALL), pe AS (SELECT entity, count(*) AS pe FROM e GROUP BY entity),
ln AS (SELECT entity, sum(le) AS ln FROM le GROUP BY entity),
h AS (SELECT q, entity, sum(0.5 * (coalesce(le, 0) + 2000.0 * a / al) / (ln + 2000.0) + 0.5 / 2 * coalesce(le, 0) / pe) AS by_label FROM g JOIN sl USING (q) JOIN al USING (label) JOIN pe USING (entity) JOIN ln USING (entity) LEFT JOIN le USING (entity, label) GROUP BY q, entity)
SELECT q, entity, round(by_seeds, 8) AS by_seeds, round(by_caption, 8) AS by_caption, round(by_label, 8) AS by_label,
round(1e3 * greatest(by_seeds, 1e-6) * greatest(by_caption, 1e-6) * greatest(by_label, 1e-6), 7) AS score FROM g JOIN s USING (q, entity) JOIN h USING (q, entity)""")
def entity_scores(t):
    """Suppliers by what they share with each nation's seed, with the words of a caption and with two labels."""
    e, labels, words, seeds, own = _parts(t)
    asked = seeds.select("q", F.explode(F.array(F.lit("NOT"), F.lit("LOW"))).alias("word"))
    words = words.groupBy("tab", "word").agg(F.count("*").alias("tf"))
    s = R.entity_scores(e, labels, words, seeds, own, asked)
    return s.select("q", "entity", *[F.round(c, 8).alias(c) for c in ("by_seeds", "by_caption", "by_label")], F.round(1e3 * F.col("score"), 7).alias("score"))


_CAND = "x AS (SELECT DISTINCT c_nationkey AS q, c_mktsegment AS asked, s_suppkey % 97 AS cand, CASE s_suppkey % 3 WHEN 0 THEN c_mktsegment ELSE CASE s_suppkey % 2 WHEN 0 THEN 'FURNITURE' ELSE 'MACHINERY' END END AS header FROM customer JOIN supplier ON s_nationkey = c_nationkey)"
_NEAR = "v AS (SELECT DISTINCT c_mktsegment AS h, c_nationkey AS n FROM customer WHERE c_acctbal > 9000), n AS (SELECT a.h, b.h AS o, count(*)::DOUBLE AS sim FROM v a JOIN v b USING (n) WHERE a.h <> b.h GROUP BY ALL)"


def _headers(how):
    near = "coalesce(n.sim, -1)" if how == "shared" else "-1"

    @query(
        f"""WITH {_CAND}, {_NEAR}, s AS (SELECT q, asked, cand, max(CASE WHEN asked = header THEN 10000.0 ELSE {near} END) AS score FROM x LEFT JOIN n ON n.h = asked AND n.o = header GROUP BY q, asked, cand)
        SELECT q, asked, cand, score, row_number() OVER (PARTITION BY q, asked ORDER BY score DESC, cand) AS rank FROM s QUALIFY rank <= 3""",
        name=f"cell_rank_{how}",
    )
    def run(t):
        s = F.col("s_suppkey")
        header = F.when(s % 3 == 0, F.col("c_mktsegment")).when(s % 2 == 0, "FURNITURE").otherwise("MACHINERY")
        both = t("customer").select("c_nationkey", "c_mktsegment").distinct().join(t("supplier"), F.col("s_nationkey") == F.col("c_nationkey"))
        x = both.select(F.struct(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("h")).alias("q"), F.col("c_mktsegment").alias("asked"), (s % 97).alias("cand"), header.alias("header"))
        v = t("customer").filter("c_acctbal > 9000").select(F.col("c_mktsegment").alias("header"), F.col("c_nationkey").alias("n")).distinct()
        shared = v.join(v.withColumnRenamed("header", "other"), "n").filter("header <> other").groupBy("header", "other").agg(F.count("*").alias("sim"))
        scored = R.header_scores(x, shared if how == "shared" else None)
        out = top_k(scored, ["q"], 3, F.col("score").desc(), F.col("cand"))
        return out.select(F.col("q.n").alias("q"), F.col("q.h").alias("asked"), "cand", "score", F.col("rank").cast("long").alias("rank"))


for _how in ("exact", "shared"):
    _headers(_how)

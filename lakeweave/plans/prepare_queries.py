"""Imputation, bins, splits and noise; language-model retrieval; reports and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeweave.operators import lake as L
from lakeweave.operators import prepare as P
from lakeweave.operators import retrieval as R
from lakeweave.sources import writers as W

from .lake_queries import cells
from .registry import query


def md5_sql(seed, *keys):
    return f"(('0x' || substr(md5('{seed}:' || " + " || ':' || ".join(f"{k}::VARCHAR" for k in keys) + "), 1, 8))::BIGINT % 2147483648)"


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS x, c_mktsegment FROM customer), f AS (SELECT min(x) AS a, max(x) AS b, median(x) AS m FROM c)
SELECT c_custkey, round((coalesce(x, m) - a) / (b - a), 6) AS x, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment FROM c, f""")
def ordinal_minmax_impute(t):
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("x"), "c_mktsegment")
    return P.ordinal(P.min_max(c, ["x"]), "c_mktsegment")


@query("""WITH e AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem)
SELECT bin, count(*) AS n, min(p) AS low, max(p) AS high FROM (SELECT l_extendedprice AS p, (l_extendedprice > q[1])::INT + (l_extendedprice > q[2])::INT + (l_extendedprice > q[3])::INT AS bin FROM lineitem, e) GROUP BY bin""")
def quantile_binning(t):
    b = P.quantile_bins(t("lineitem").select(F.col("l_extendedprice").alias("p")), "p", 4)
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))


_SHARES = {"train": 0.6, "dev": 0.15, "test": 0.25}


def _split_sql(k):
    return f"CASE WHEN {md5_sql('split', k)} / 2147483648.0 < 0.6 THEN 'train' WHEN {md5_sql('split', k)} / 2147483648.0 < 0.75 THEN 'dev' ELSE 'test' END"


@query(f"SELECT doc_id, {_split_sql('source')} AS split FROM documents")
def hash_split(t):
    return P.hash_split(t("documents").select("doc_id", "source"), "source", _SHARES).select("doc_id", "split")


@query(f"SELECT l_partkey, l_suppkey, {_split_sql('l_partkey')} AS split FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) WHERE {_split_sql('l_partkey')} = {_split_sql('l_suppkey')}")
def table_disjoint_split(t):
    return P.disjoint_pairs(t("lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey", "l_suppkey", _SHARES)


@query(f"""SELECT n_nationkey, CASE WHEN r <= 10 THEN 'train' ELSE 'test' END AS split FROM (SELECT n_nationkey, row_number() OVER (ORDER BY {md5_sql('split', 'n_nationkey')}, n_nationkey) AS r FROM nation) WHERE r <= 20""")
def exact_split(t):
    return P.exact_split(t("nation"), "n_nationkey", {"train": 10, "test": 10}).select("n_nationkey", "split")


#: What stands for the keys of the two tables.
KEYS = ("n_name", "c_name")
_SWAP = "CASE WHEN length(value) < 2 THEN value ELSE substr(value, 1, (k // 3 % greatest(length(value) - 1, 1))::INT) || substr(value, (k // 3 % greatest(length(value) - 1, 1))::INT + 2, 1) || substr(value, (k // 3 % greatest(length(value) - 1, 1))::INT + 1, 1) || substr(value, (k // 3 % greatest(length(value) - 1, 1))::INT + 3) END"


def _noise(tier):
    from .lake_queries import CELLS_SQL

    @query(
        f"""WITH {CELLS_SQL}, r AS (SELECT *, col IN {KEYS} AS is_key, {md5_sql("noise", "table_id", "row_idx", "col")} AS roll, {md5_sql("noise:name", "table_id", "col")} AS name FROM cells WHERE table_id IN ('nation', 'customer')),
        k AS (SELECT *, roll // 100 AS k FROM r)
        SELECT table_id, row_idx, CASE WHEN name % 100 >= 70 THEN col ELSE [lower(col), upper(col), replace(col, ' ', '_'), replace(col, '_', ' '), rtrim(col) || ' '][name // 100 % 5 + 1] END AS col,
        CASE WHEN is_key AND {tier} >= 3 AND roll % 100 < 10 THEN
          CASE k % 3 WHEN 0 THEN {_SWAP} WHEN 1 THEN value || ' ' ELSE CASE WHEN length(value) < 2 THEN value ELSE substr(value, 1, length(value) - 1) END END
        WHEN NOT is_key AND {tier} >= 2 AND roll % 100 < 5 THEN
          CASE k % 3 WHEN 0 THEN CASE WHEN value IS NULL THEN NULL ELSE '' END WHEN 1 THEN {_SWAP} ELSE CASE WHEN length(value) < 3 THEN value ELSE substr(value, 1, length(value) // 2) END END
        ELSE value END AS value FROM k""",
        name=f"noise_tier{tier}",
    )
    def run(t):
        c = cells(t).filter(F.col("table_id").isin("nation", "customer"))
        return P.noisy_cells(c, tier, F.col("col").isin(*KEYS), "noise").select("table_id", "row_idx", "col", "value")


for _tier in (1, 2, 3):
    _noise(_tier)


@query(f"""WITH r AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part),
f AS (SELECT *, CASE WHEN {md5_sql('swap:mask', 'p_partkey')} % 100 < 30 THEN {md5_sql('swap:from', 'p_partkey')} % n ELSE i END AS src FROM r)
SELECT f.p_partkey, g.p_size, f.p_size <> g.p_size AS changed FROM f JOIN r g ON g.i = f.src""")
def corruption_swap(t):
    return P.swap_corruption(t("part").select("p_partkey", "p_size"), "p_partkey", "p_size", 30, "swap").select("p_partkey", "p_size", "changed")


_POST = """d AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents), dt AS (SELECT doc_id, w, count(*) AS tf FROM d WHERE w <> '' GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS dl FROM dt GROUP BY doc_id), c AS (SELECT w, sum(tf) AS ctf FROM dt GROUP BY w), cl AS (SELECT sum(ctf)::DOUBLE AS cl FROM c),
q0 AS (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM benchmark), q AS (SELECT item_id, w, count(*) AS qtf FROM q0 WHERE w <> '' GROUP BY ALL)"""


def _lm(how, prob):
    @query(
        f"""WITH {_POST}, cand AS (SELECT DISTINCT item_id, doc_id FROM q JOIN dt USING (w)),
        s AS (SELECT cand.item_id, cand.doc_id, round(sum(qtf * ln({prob})), 6) AS score FROM cand JOIN q USING (item_id) JOIN c USING (w) JOIN len USING (doc_id) LEFT JOIN dt ON dt.doc_id = cand.doc_id AND dt.w = q.w, cl GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""",
        name=f"lm_{how}",
    )
    def run(t):
        q = t("benchmark").select(F.col("item_id").alias("qid"), "text")
        out = R.query_likelihood(R.postings(q, "qid", "text", "[^a-z0-9]+"), R.words_of(t("documents"), "doc_id", "did"), how, 5)
        return out.select(F.col("qid").alias("item_id"), F.col("did").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


_lm("dirichlet", "(coalesce(tf, 0) + 2000.0 * ctf / cl) / (dl + 2000.0)")
_lm("jelinek_mercer", "0.9 * coalesce(tf, 0) / dl + 0.1 * ctf / cl")


@query(f"WITH {_POST} SELECT (SELECT count(*) FROM len) AS doc_count, (SELECT cl FROM cl)::BIGINT AS length, (SELECT round(avg(dl), 6) FROM len) AS avg_len, (SELECT count(*) FROM c) AS terms, (SELECT max(n) FROM (SELECT count(*) AS n FROM dt GROUP BY w)) AS max_doc_freq")
def collection_statistics(t):
    return R.statistics(R.words_of(t("documents"), "doc_id", "did"))


_RANKS = """WITH d AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents), q AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM benchmark),
h AS (SELECT item_id, doc_id, count(*) AS score FROM q JOIN d USING (w) WHERE w <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= 20),
g AS (SELECT *, doc_id % 4 = item_id % 4 AS gold FROM r)"""


def _ranked(t):
    q = R.postings(t("benchmark").select(F.col("item_id").alias("qid"), "text"), "qid", "text", "[^a-z0-9]+")
    h = R.overlaps(q, R.words_of(t("documents"), "doc_id", "did"), 20).select(F.col("qid").alias("item_id"), F.col("did").alias("doc_id"), F.col("hits").alias("score"), "rank")
    return h.withColumn("gold", F.col("doc_id") % 4 == F.col("item_id") % 4)


@query(f"{_RANKS} SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS n FROM g WHERE NOT gold QUALIFY n <= 5")
def hard_negatives(t):
    return L.top_k(_ranked(t).filter("not gold"), ["item_id"], 5, F.col("rank"), name="n").select("item_id", "doc_id", F.col("n").cast("long").alias("n"))


@query(f"""{_RANKS}, p AS (SELECT *, sum(gold::INT) OVER (PARTITION BY item_id ORDER BY rank) AS seen FROM g),
k AS (SELECT *, CASE WHEN gold THEN 'positive' WHEN rank <= 5 + seen THEN 'hard_negative' ELSE 'negative' END AS kind FROM p)
SELECT item_id, doc_id, kind, row_number() OVER (PARTITION BY item_id, kind ORDER BY rank) AS n FROM k QUALIFY n <= 3""")
def curated_contexts(t):
    """Positives, hard negatives (the first 5 ranks, as many further as positives came before) and others, three of each."""
    seen = F.sum(F.col("gold").cast("int")).over(Window.partitionBy("item_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kind = F.when(F.col("gold"), "positive").when(F.col("rank") <= 5 + F.col("_seen"), "hard_negative").otherwise("negative")
    k = _ranked(t).withColumn("_seen", seen).withColumn("kind", kind)
    return L.top_k(k, ["item_id", "kind"], 3, F.col("rank"), name="n").select("item_id", "doc_id", "kind", F.col("n").cast("long").alias("n"))


@query("""WITH r AS (SELECT 'm' || user_id % 7 AS model, event_type AS dataset, event_id % 3 AS seed, avg(value) AS v FROM events GROUP BY ALL),
c AS (SELECT model, dataset, avg(v) AS m, stddev_samp(v) AS s, count(DISTINCT seed) AS seeds FROM r GROUP BY ALL)
SELECT model, """ + ", ".join(f"round(max(m) FILTER (dataset = '{d}'), 4) AS {d}_mean, round(max(s) FILTER (dataset = '{d}'), 4) AS {d}_std" for d in ("click", "purchase")) + ", round(avg(m), 4) AS average, min(seeds) = 3 AS complete FROM c GROUP BY model")
def leaderboard_pivot(t):
    r = t("events").groupBy(F.concat(F.lit("m"), F.col("user_id") % 7).alias("model"), F.col("event_type").alias("dataset"), (F.col("event_id") % 3).alias("seed")).agg(F.avg("value").alias("v"))
    c = r.groupBy("model", "dataset").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.countDistinct("seed").alias("seeds"))
    wide = c.groupBy("model").pivot("dataset", ["click", "purchase"]).agg(F.round(F.max("m"), 4).alias("mean"), F.round(F.max("s"), 4).alias("std"))
    return wide.join(c.groupBy("model").agg(F.round(F.avg("m"), 4).alias("average"), (F.min("seeds") == 3).alias("complete")), "model")


@query("""SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id DESC) = 1""")
def last_wins_merge(t):
    """Shards by event_id % 4: the last record of the last shard wins. A maximum of structs is summed up before the shuffle."""
    last = F.max(F.struct((F.col("event_id") % 4).alias("shard"), "event_id", "value")).alias("x")
    return t("events").groupBy("user_id").agg(last).select("user_id", "x.event_id", "x.value")


@query("SELECT n_name, ntile(4) OVER (ORDER BY n_name) AS shard FROM nation")
def shard_ntile(t):
    return W.shards_of(t("nation").select("n_name"), "n_name", 4)


@query("SELECT r_regionkey, k.n_nationkey FROM region, (SELECT n_nationkey FROM nation) k WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r_regionkey AND n.n_nationkey = k.n_nationkey)")
def coverage_grid_missing(t):
    """The grid of two small lists, without what is there: left_anti against the results."""
    grid = t("region").select("r_regionkey").join(F.broadcast(t("nation").select("n_nationkey")), F.lit(True))
    return grid.join(t("nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey"), ["r_regionkey", "n_nationkey"], "left_anti")


@query("""SELECT o_orderstatus AS split, CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS tier, count(*) AS n, round(avg(o_totalprice), 4) AS mean
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))""")
def tier_metrics_grouping_sets(t):
    g = t("orders").groupingSets([["o_orderstatus"], ["o_orderstatus", "o_orderpriority"]], "o_orderstatus", "o_orderpriority")
    out = g.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.grouping("o_orderpriority").alias("g"))
    return out.select(F.col("o_orderstatus").alias("split"), F.when(F.col("g") == 1, "all").otherwise(F.col("o_orderpriority")).alias("tier"), "n", "mean")


@query("""WITH c AS (SELECT o_custkey % 50 AS qid, CASE WHEN o_orderstatus = 'F' THEN 'union' ELSE 'join' END AS relation, o_totalprice AS conf, o_orderkey AS rank FROM orders)
SELECT qid, relation, conf, rank FROM c QUALIFY row_number() OVER (PARTITION BY qid, relation ORDER BY conf DESC, rank) = 1""")
def best_candidates(t):
    c = t("orders").select((F.col("o_custkey") % 50).alias("qid"), F.when(F.col("o_orderstatus") == "F", "union").otherwise("join").alias("relation"), F.col("o_totalprice").alias("conf"), F.col("o_orderkey").alias("rank"))
    return L.top_k(c, ["qid", "relation"], 1, F.col("conf").desc(), F.col("rank"), name="_n").drop("_n")


_MIX = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part),
c AS ({" UNION ALL ".join(f"SELECT p_partkey, i, n, '{c}' AS col, {c}::VARCHAR AS value FROM r" for c in _MIX)}),
d AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY {md5_sql('mix:mask', 'p_partkey', 'col')}, col) <= 3 AS hit FROM c),
f AS (SELECT d.p_partkey, d.col, d.hit, o.value FROM d JOIN c o ON o.col = d.col AND o.i = CASE WHEN d.hit THEN {md5_sql('mix:from', 'd.p_partkey', 'd.col')} % d.n ELSE d.i END)
SELECT p_partkey, {", ".join(f"max(value) FILTER (col = '{c}')" + {"p_size": "::INT", "p_retailprice": "::DOUBLE"}.get(c, "") + f" AS {c}" for c in _MIX)}, list(col ORDER BY col) FILTER (hit) AS changed FROM f GROUP BY p_partkey""")
def corruption_exact(t):
    """Three of five columns of every part, for a share of 0.7."""
    return P.exact_corruption(t("part").select("p_partkey", *_MIX), "p_partkey", _MIX, 0.7, "mix")

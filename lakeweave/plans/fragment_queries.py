"""Fragments of parents, properties that lead to values, words bound to a topic, and boosted trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.functions import serialise as S
from lakeweave.operators import fragments as FR
from lakeweave.operators import models, program

from .prepare_queries import md5_sql
from .registry import query

#: The key and the columns of the parents.
PARENTS = {"customer": ("c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]), "part": ("p_partkey", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"])}
_PARTS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS table_id, {key}::BIGINT AS row_idx, {i}::INT AS col_idx, '{c}' AS col FROM {name}" for name, (key, rest) in PARENTS.items() for i, c in enumerate([key, *rest])
)


def parents(t):
    """The cells of the parents and their key columns; a row's number is its key."""
    out = None
    for name, (key, rest) in PARENTS.items():
        each = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for i, c in enumerate([key, *rest])])
        one = t(name).select(F.lit(name).alias("table_id"), F.col(key).cast("long").alias("row_idx"), F.explode(each).alias("x")).select("table_id", "row_idx", "x.*")
        out = one if out is None else out.unionByName(one)
    return out, out.select("table_id", F.lit(0).alias("key_idx")).distinct()


@query(f"""WITH c AS ({_PARTS_SQL}), k AS (SELECT DISTINCT table_id, col_idx FROM c WHERE col_idx > 0), m AS (SELECT table_id, count(*)::INT AS m FROM k GROUP BY 1),
g AS (SELECT k.*, m, row_number() OVER (PARTITION BY table_id ORDER BY {md5_sql('0:col', 'table_id', 'col_idx')}, col_idx) AS r FROM k JOIN m USING (table_id)),
own AS (SELECT table_id, col_idx FROM g WHERE r <= least(greatest(2, round_even((0.35 + 0.15 * ({md5_sql('0:cols', 'table_id')} + 0.5) / 2147483648.0) * m, 0)), m - 2)),
w AS (SELECT table_id, row_idx, count(*) OVER (PARTITION BY table_id) AS n, row_number() OVER (PARTITION BY table_id ORDER BY {md5_sql('0:row', 'table_id', 'row_idx')}, row_idx) AS r FROM c WHERE col_idx = 0),
s AS (SELECT table_id, row_idx, r <= least(greatest(10, round_even((0.6 + 0.2 * ({md5_sql('0:rows', 'table_id')} + 0.5) / 2147483648.0) * n, 0)), n - 5) AS seed FROM w),
f AS (SELECT c.*, s.seed, own.col_idx IS NOT NULL AS mine FROM c JOIN s USING (table_id, row_idx) LEFT JOIN own USING (table_id, col_idx)),
a AS (SELECT table_id, row_idx, col, CASE WHEN seed THEN 'seed' ELSE 'union' END AS kind FROM f WHERE mine OR col_idx = 0 UNION ALL SELECT table_id, row_idx, col, 'join' FROM f WHERE NOT mine OR col_idx = 0)
SELECT table_id, kind, col, count(*) AS n, sum(row_idx)::BIGINT AS rows_sum FROM a GROUP BY ALL""")
def fragment_split(t):
    return FR.base_split(*parents(t)).groupBy("table_id", "kind", "col").agg(F.count("*").alias("n"), F.sum("row_idx").alias("rows_sum"))


def _manifest(tier: int) -> None:
    @query(name=f"fragment_manifest_t{tier}")
    def run(t):
        return FR.manifest(FR.fragments(*parents(t), tier))


for _tier in range(4):
    _manifest(_tier)


@query("""SELECT 'r.brand-string' AS prop WHERE EXISTS (SELECT 1 FROM part WHERE p_brand = '5') UNION ALL SELECT 'r.size-number' WHERE EXISTS (SELECT 1 FROM part WHERE p_size = 5)""")
def connected_props(t):
    rows = program.table_of(t("part"), "p_partkey", {"r.brand-string": ("p_brand", "string"), "r.size-number": ("p_size", "double")})
    found = program.Program(rows).connected(rows, ["5"])
    return rows.sparkSession.createDataFrame([(p,) for p in found], "prop string")


@query("""WITH k AS (SELECT o_custkey AS t, o_orderkey AS o, o_orderpriority AS a, o_orderstatus AS v FROM orders), b AS (SELECT a, v, count(*) AS b FROM k GROUP BY ALL),
s AS (SELECT a, v, b / (sum(b) OVER (PARTITION BY a) * sum(b) OVER (PARTITION BY v)) AS s FROM b), p AS (SELECT t, a, s.v, min(o) AS o, any_value(s) AS s FROM k JOIN s USING (a, v) GROUP BY ALL),
w AS (SELECT t, s, o, unnest(string_split(a, ' ')) AS token, generate_subscripts(string_split(a, ' '), 1) AS i FROM p), f AS (SELECT t, token, min(row(-s, o, i)) AS x FROM w GROUP BY ALL),
r AS (SELECT t, token, x, row_number() OVER (PARTITION BY t ORDER BY x) AS place FROM f), y AS (SELECT *, min(place) OVER (PARTITION BY t, x[1], x[2]) - 1 AS before FROM r)
SELECT t, place::INT AS place, token FROM y WHERE before < 3""")
def token_sample_pmi(t):
    o = t("orders").select(F.col("o_custkey").alias("t"), F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("v"))
    return S.pmi_sample(o, "t", "o", "a", "v", 3, of_topic=True)


@query()
def probe_boosted(t):
    p = t("part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.length("p_name").cast("double")).alias("v"), F.concat("p_retailprice", F.lit("%")).alias("y"))
    return models.boosted_probe(p, "p_partkey", "v", "y")

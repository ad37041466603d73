"""Searches for programs, and what was tried before."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.operators import ranks, search, tried

from .registry import query

PROPS = {"p_name": "string", "p_type": "string", "p_size": "number", "p_retailprice": "number"}
LEAST = "30"

#: Rows of a level (env, path, row, n, root) from those of the one before, path by path and without states.
_STEP = """
s{d} AS (SELECT env, path, row, any_value(root) AS root, count(*) OVER (PARTITION BY env, path) AS n FROM r{d} GROUP BY env, path, row),
b{d} AS (SELECT s.*, c.prop, c.kind, c.value, TRY_CAST(c.value AS DOUBLE) AS x FROM s{d} s JOIN cells c ON c.env = s.env AND c.row = s.row),"""
_ROWS = """
f{d} AS (SELECT b.env, b.path || chr(10) || '( ' || op || ' {v} ' || g.value || ' ' || prop || ' )' AS path, b.row, b.n FROM b{d} b JOIN given g USING (env),
  (VALUES ('filter_ge'), ('filter_greater'), ('filter_le'), ('filter_less'), ('filter_eq'), ('filter_not_eq'), ('filter_str_contain_any'), ('filter_str_contain_not_any')) o(op)
  WHERE n > 1 AND CASE WHEN g.x IS NOT NULL AND kind = 'number' THEN
    CASE op WHEN 'filter_ge' THEN coalesce(b.x >= g.x, false) WHEN 'filter_greater' THEN coalesce(b.x > g.x, false) WHEN 'filter_le' THEN coalesce(b.x <= g.x, false)
      WHEN 'filter_less' THEN coalesce(b.x < g.x, false) WHEN 'filter_eq' THEN coalesce(b.x = g.x, false) WHEN 'filter_not_eq' THEN coalesce(b.x <> g.x, true) ELSE false END
  WHEN g.x IS NULL AND kind = 'string' THEN
    CASE op WHEN 'filter_eq' THEN coalesce(b.value = g.value, false) WHEN 'filter_not_eq' THEN coalesce(b.value <> g.value, true)
      WHEN 'filter_str_contain_any' THEN coalesce(contains(b.value, g.value), false) WHEN 'filter_str_contain_not_any' THEN coalesce(NOT contains(b.value, g.value), false) ELSE false END
  ELSE false END),
e{d} AS (SELECT env, path || chr(10) || '( ' || op || ' {v} ' || prop || ' )' AS path, row, n FROM
  (SELECT *, max(x) OVER w AS high, min(x) OVER w AS low FROM b{d} WHERE n > 1 AND kind = 'number' AND x IS NOT NULL WINDOW w AS (PARTITION BY env, path, prop)), (VALUES ('argmax'), ('argmin')) o(op)
  WHERE CASE op WHEN 'argmax' THEN x = high ELSE x = low END),
u{d} AS (SELECT env, path, row FROM (SELECT *, count(*) OVER (PARTITION BY env, path) AS m FROM (SELECT * FROM f{d} UNION ALL SELECT * FROM e{d})) WHERE m < n),
t{d} AS (SELECT s.env, s.path || chr(10) || '( ' || op || ' {v} )' AS path, CASE op WHEN 'first' THEN min(row) ELSE max(row) END AS row FROM s{d} s, (VALUES ('first'), ('last')) o(op) WHERE n > 1 GROUP BY s.env, s.path, op),
m{d} AS (SELECT s.env, s.path || chr(10) || '( ' || op || ' {v} )' AS path, s.row + k AS row FROM s{d} s, (VALUES ('next', 1), ('previous', -1)) o(op, k)
  WHERE NOT root AND EXISTS (FROM cells c WHERE c.env = s.env AND c.row = s.row + k)),
w{d} AS (SELECT b.env, b.path || chr(10) || '( same {v} ' || b.prop || ' )' AS path, c.row FROM b{d} b JOIN cells c USING (env, prop) WHERE n = 1 AND c.value = b.value AND c.row <> b.row),
r{e} AS MATERIALIZED (SELECT *, false AS root FROM (SELECT * FROM u{d} UNION ALL SELECT * FROM t{d} UNION ALL SELECT * FROM m{d} UNION ALL SELECT * FROM w{d})),"""
_LAST = """
q{d} AS (SELECT env, path || chr(10) || '( hop {v} ' || prop || ' )' AS path, value FROM b{d} WHERE value IS NOT NULL
  UNION ALL SELECT env, path || chr(10) || '( count {v} )', n::VARCHAR FROM s{d} WHERE n > 1
  UNION ALL SELECT env, path || chr(10) || '( mode {v} ' || prop || ' )', value FROM (SELECT env, path, prop, value FROM b{d} WHERE n > 1 AND value IS NOT NULL GROUP BY env, path, prop, value
    QUALIFY rank() OVER (PARTITION BY env, path, prop ORDER BY count(*) DESC) = 1)
  UNION ALL SELECT env, path || chr(10) || '( ' || op || ' {v} ' || prop || ' )', CASE op WHEN 'maximum' THEN max(x) WHEN 'minimum' THEN min(x) WHEN 'sum' THEN sum(x) ELSE avg(x) END::VARCHAR
    FROM b{d}, (VALUES ('maximum'), ('minimum'), ('sum'), ('average')) o(op) WHERE n > 1 AND kind = 'number' AND x IS NOT NULL GROUP BY env, path, prop, op),
p{d} AS (SELECT env, path, list(DISTINCT coalesce(TRY_CAST(value AS DOUBLE)::VARCHAR, lower(value))) AS v FROM q{d} GROUP BY env, path),
z{d} AS (SELECT env, path, {n} AS n_expressions FROM p{d} JOIN goal USING (env) WHERE len(v) = len(want)
  AND list_bool_and([list_bool_or([y = x OR coalesce(abs(TRY_CAST(y AS DOUBLE) - TRY_CAST(x AS DOUBLE)) < 1e-6, false) FOR y IN v]) FOR x IN want])),"""


def _sql(depth: int) -> str:
    text = f"""WITH part0 AS (SELECT *, p_brand AS env, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row FROM part),
    cells AS MATERIALIZED ({' UNION ALL '.join(f"SELECT env, row, '{p}' AS prop, '{kind}' AS kind, {p}{'::DOUBLE' if kind == 'number' else ''}::VARCHAR AS value FROM part0" for p, kind in PROPS.items())}),
    given AS (SELECT DISTINCT env, value, TRY_CAST(value AS DOUBLE) AS x FROM (SELECT env, '{LEAST}' AS value FROM part0 UNION ALL SELECT env, min(p_type) FROM part0 GROUP BY env)),
    goal AS (SELECT env, list(DISTINCT lower(p_name)) AS want FROM (SELECT env, p_name FROM part0 WHERE p_size >= {LEAST} QUALIFY rank() OVER (PARTITION BY env ORDER BY p_retailprice DESC) = 1) GROUP BY env),
    r0 AS (SELECT env, '' AS path, row, true AS root FROM part0),"""
    for d in range(depth):
        text += _STEP.replace("{d}", str(d)) + _LAST.replace("{d}", str(d)).replace("{n}", str(d + 1))
        if d < depth - 1:
            text += _ROWS.replace("{d}", str(d)).replace("{e}", str(d + 1))
    # the k-th expression works on the one before
    lines = "array_to_string([replace(x, '{v}', CASE WHEN i = 1 THEN 'all_rows' ELSE 'v' || (i - 2) END) FOR x, i IN string_split(ltrim(path, chr(10)), chr(10))], chr(10))"
    return text + f" a AS ({' UNION ALL '.join(f'SELECT * FROM z{d}' for d in range(depth))}) SELECT env AS brand, {lines} AS program, n_expressions FROM a"


def brands(t) -> search.Questions:
    """A question for each brand: the names of its dearest parts of size 30 or more; it names 30 and the first type."""
    part = ranks.placed(t("part").withColumn("env", F.col("p_brand")), "p_partkey", [], "row", ["p_brand"])
    part = part.withColumn("p_size", F.col("p_size").cast("double"))
    large = part.filter(F.col("p_size") >= float(LEAST))
    dearest = large.groupBy("env").agg(F.max("p_retailprice").alias("p_retailprice"))
    types = part.groupBy("env").agg(F.min("p_type").alias("value"))
    return search.Questions(
        search.cells_of(part, "p_brand", "row", PROPS),
        types.select("env", F.col("env").alias("tab")),
        types.unionByName(types.select("env", F.lit(LEAST).alias("value"))),
        large.join(ranks.beside(dearest), ["env", "p_retailprice"]).select("env", F.col("p_name").alias("value")),
    )


@query(_sql(3))
def program_search(t):
    return search.search(brands(t), 3).withColumnRenamed("env", "brand")


_PROGRAM = "'( filter_ge all_rows ' || (floor(o_totalprice / 1000)::BIGINT) || ' r.price-number )' || chr(10) || '( filter_eq v0 ' || o_orderpriority || ' r.priority-string )'"


@query(f"""WITH p AS (SELECT year(o_orderdate)::INT AS round, {_PROGRAM} AS program FROM orders), f AS (SELECT program, min(round) AS round FROM p GROUP BY program)
SELECT p.round, count(*) AS proposed, count(*) FILTER (WHERE f.round < p.round) AS tried, count(DISTINCT program) FILTER (WHERE f.round = p.round) AS "new" FROM p JOIN f USING (program) GROUP BY p.round""")
def tried_programs(t):
    """Programs that the orders of each year propose, and how many of them an earlier year has tried."""
    least = F.floor(F.col("o_totalprice") / 1000).cast("string")
    program = F.concat(F.lit("( filter_ge all_rows "), least, F.lit(" r.price-number )\n( filter_eq v0 "), "o_orderpriority", F.lit(" r.priority-string )"))
    return tried.rounds(t("orders").select(F.year("o_orderdate").alias("round"), program.alias("program")), "round", "program")

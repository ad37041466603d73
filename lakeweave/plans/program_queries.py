"""Table programs over parts and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.functions import cleaning as C
from lakeweave.operators import program as P

from .registry import query

ORDERS = {"r.priority-string": ("o_orderpriority", "string"), "r.placed-date": ("day", "string")}
PROPS = {"r.name-string": ("p_name", "string"), "r.brand-string": ("p_brand", "string"), "r.type-string": ("p_type", "string"), "r.size-number": ("p_size", "double"), "r.price-number": ("p_retailprice", "double")}


def part(t):
    return P.table_of(t("part"), "p_partkey", PROPS)


def _program(name, text, sql, kind="rows"):
    @query(sql, name=name)
    def run(t):
        out = P.Program(part(t)).run(text).data
        return out.select(F.col("row_idx").alias("p_partkey")) if kind == "rows" else out.select("value")


_program("prog_hop", "( hop all_rows r.brand-string )", "SELECT DISTINCT p_brand AS value FROM part", "values")
_program("prog_hop_bag", "( all all_rows r.brand-string )", "SELECT p_brand AS value FROM part WHERE p_brand IS NOT NULL", "values")
_program("prog_filter_eq", "( filter_eq all_rows 15 r.size-number )", "SELECT p_partkey FROM part WHERE p_size = 15")
_program("prog_filter_not_eq", "( filter_not_eq all_rows 15 r.size-number )", "SELECT p_partkey FROM part WHERE p_size <> 15 OR p_size IS NULL")
_program("prog_filter_ge", "( filter_ge all_rows 30 r.size-number )", "SELECT p_partkey FROM part WHERE p_size >= 30")
_program("prog_filter_greater", "( filter_greater all_rows 30 r.size-number )", "SELECT p_partkey FROM part WHERE p_size > 30")
_program("prog_filter_le", "( filter_le all_rows 30 r.size-number )", "SELECT p_partkey FROM part WHERE p_size <= 30")
_program("prog_filter_less", "( filter_less all_rows 30 r.size-number )", "SELECT p_partkey FROM part WHERE p_size < 30")
_program("prog_contains_any", "( filter_str_contain_any all_rows 'a' r.name-string )", "SELECT p_partkey FROM part WHERE contains(p_name, 'a')")
_program("prog_contains_none", "( filter_str_contain_not_any all_rows 'a' r.name-string )", "SELECT p_partkey FROM part WHERE NOT contains(p_name, 'a')")
_program("prog_argmax", "( argmax all_rows r.size-number )", "SELECT p_partkey FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
_program("prog_argmin", "( argmin all_rows r.size-number )", "SELECT p_partkey FROM part WHERE p_size = (SELECT min(p_size) FROM part)")
_program("prog_mode", "( mode all_rows r.size-number )", "SELECT p_size::DOUBLE AS value FROM part GROUP BY p_size QUALIFY rank() OVER (ORDER BY count(*) DESC) = 1", "values")
_program("prog_first", "( first all_rows )", "SELECT min(p_partkey) AS p_partkey FROM part")
_program("prog_last", "( last all_rows )", "SELECT max(p_partkey) AS p_partkey FROM part")
_program("prog_next", "( filter_eq all_rows 15 r.size-number )\n( next v0 )", "SELECT p_partkey FROM part WHERE p_partkey - 1 IN (SELECT p_partkey FROM part WHERE p_size = 15)")
_program("prog_previous", "( filter_eq all_rows 15 r.size-number )\n( previous v0 )", "SELECT p_partkey FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part WHERE p_size = 15)")
_program("prog_count", "( count all_rows )", "SELECT count(*)::DOUBLE AS value FROM part", "values")
_program("prog_max", "( maximum all_rows r.price-number )", "SELECT max(p_retailprice) AS value FROM part", "values")
_program("prog_min", "( minimum all_rows r.price-number )", "SELECT min(p_retailprice) AS value FROM part", "values")
_program("prog_sum", "( sum all_rows r.size-number )", "SELECT coalesce(sum(p_size), 0)::DOUBLE AS value FROM part", "values")
_program("prog_average", "( average all_rows r.size-number )", "SELECT avg(p_size) AS value FROM part", "values")
_program("prog_same", "( first all_rows )\n( same v0 r.brand-string )", "SELECT p_partkey FROM part WHERE p_brand = (SELECT arg_min(p_brand, p_partkey) FROM part) AND p_partkey <> (SELECT min(p_partkey) FROM part)")
_program("prog_diff", "( first all_rows )\n( last all_rows )\n( diff v0 v1 r.size-number )", "SELECT abs((SELECT arg_min(p_size, p_partkey) FROM part) - (SELECT arg_max(p_size, p_partkey) FROM part))::DOUBLE AS value", "values")


def _select(name, sign):
    @query(
        f"""WITH t AS (SELECT p_partkey AS k, p_size AS s FROM part WHERE p_partkey IN (11, 17)), x AS (SELECT arg_min(s, k) AS a, arg_max(s, k) AS b, min(k) AS i, max(k) AS j FROM t)
        SELECT CASE WHEN a {sign} b THEN i ELSE j END AS p_partkey FROM x""",
        name=f"prog_{name}",
    )
    def run(t):
        p = P.Program(part(t))
        p.names["two"] = P.Value("entity_list", p.table.filter("row_idx in (11, 17)"))
        return p.run(f"( {name} two r.size-number )").data.select(F.col("row_idx").alias("p_partkey"))


_select("select_ge", ">=")
_select("select_less", "<")


def _dates(name, function, given, sql):
    @query(f"SELECT o_orderkey FROM orders WHERE {sql}", name=f"prog_date_{name}")
    def run(t):
        rows = P.table_of(t("orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")), "o_orderkey", ORDERS)
        return P.Program(rows).run(f"( {function} all_rows '{given}' r.placed-date )").data.select(F.col("row_idx").alias("o_orderkey"))


_dates("month", "filter_ge", "xx-06-xx", "month(o_orderdate) >= 6")
_dates("year", "filter_less", "1997-xx-xx", "year(o_orderdate) < 1997")
_dates("day", "filter_greater", "1997-06-15", "365 * year(o_orderdate) + 30 * month(o_orderdate) + day(o_orderdate) > 365 * 1997 + 30 * 6 + 15")

_program(
    "prog_chain_filter_argmax_hop", "( filter_ge all_rows 40 r.size-number )\n( argmax v0 r.price-number )\n( hop v1 r.name-string )",
    "WITH f AS (SELECT * FROM part WHERE p_size >= 40) SELECT DISTINCT p_name AS value FROM f WHERE p_retailprice = (SELECT max(p_retailprice) FROM f)", "values",
)
_program(
    "prog_chain_next_filter_count", "( filter_less all_rows 5 r.size-number )\n( next v0 )\n( filter_ge v1 20 r.size-number )\n( count v2 )",
    "SELECT count(*)::DOUBLE AS value FROM part WHERE p_size >= 20 AND p_partkey - 1 IN (SELECT p_partkey FROM part WHERE p_size < 5)", "values",
)
_program(
    "prog_chain_mode_filter_average", "( mode all_rows r.size-number )\n( first all_rows )\n( same v1 r.brand-string )\n( average v2 r.price-number )",
    "SELECT avg(p_retailprice) AS value FROM part WHERE p_brand = (SELECT arg_min(p_brand, p_partkey) FROM part) AND p_partkey <> (SELECT min(p_partkey) FROM part)", "values",
)


@query("WITH f AS (SELECT * FROM part WHERE p_size >= 40) SELECT DISTINCT p_name AS value FROM f WHERE p_retailprice = (SELECT max(p_retailprice) FROM f)")
def prog_by_tokens(t):
    """A program read token by token, each of them one that may stand there."""
    p = P.Program(part(t), most=3)
    text = "( filter_ge all_rows 40 r.size-number ) ( argmax v0 r.price-number ) ( hop v1 r.name-string )"
    for token in [*P.tokenize(text), P.END]:
        if token != "40" and token not in p.valid_tokens():
            raise ValueError(f"{token} may not follow {p.begun}")
        out = p.read_token(token)
    return out.data


@query("""WITH c AS (SELECT p_partkey AS id, [p_brand, p_size::VARCHAR] AS targets, CASE p_partkey % 5 WHEN 0 THEN [upper(p_brand), p_size || '.0'] WHEN 1 THEN [p_brand]
WHEN 2 THEN [' ' || p_brand || '  ', p_size || '.0000001'] WHEN 3 THEN [p_brand, (p_size + 1)::VARCHAR] ELSE [p_size::VARCHAR, p_brand, lower(p_brand)] END AS predictions FROM part),
n AS (SELECT id, list_distinct(list_transform(targets, lambda x: coalesce(try_cast(x AS DOUBLE)::VARCHAR, trim(regexp_replace(lower(x), ' +', ' ', 'g'))))) AS a,
list_distinct(list_transform(predictions, lambda x: coalesce(try_cast(x AS DOUBLE)::VARCHAR, trim(regexp_replace(lower(x), ' +', ' ', 'g'))))) AS b FROM c),
u AS (SELECT id, a, b, unnest(a) AS x FROM n)
SELECT id, bool_and(len(a) = len(b) AND len(list_filter(b, lambda y: y = x OR coalesce(abs(try_cast(x AS DOUBLE) - try_cast(y AS DOUBLE)) < 1e-6, false))) > 0) AS met FROM u GROUP BY id""")
def denotation_check(t):
    brand, size, k = F.col("p_brand"), F.col("p_size"), F.col("p_partkey") % 5
    said = (
        F.when(k == 0, F.array(F.upper(brand), F.concat(size, F.lit(".0"))))
        .when(k == 1, F.array(brand))
        .when(k == 2, F.array(F.concat(F.lit(" "), brand, F.lit("  ")), F.concat(size, F.lit(".0000001"))))
        .when(k == 3, F.array(brand, (size + 1).cast("string")))
        .otherwise(F.array(size.cast("string"), brand, F.lower(brand)))
    )
    return t("part").select(F.col("p_partkey").alias("id"), P.met_denotation(F.array(brand, size.cast("string")), said).alias("met"))


@query("SELECT o_orderkey, (strftime(o_orderdate, '%Y-%m-%d') >= '1997-06-15' AND month(o_orderdate) >= 6 AND day(o_orderdate) >= 15) AS met FROM orders")
def date_ge_each(t):
    d = C.partial_date(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t("orders").select("o_orderkey", C.date_ge_each(d, C.partial_date(F.lit("1997-06-15"))).alias("met"))


@query("""SELECT o_orderkey, (month(o_orderdate) >= 6) AS by_month, (year(o_orderdate) > 1995) AS by_year,
(365 * year(o_orderdate) + 30 * month(o_orderdate) + day(o_orderdate) <= 365 * 1996 + 30 * 6 + 15) AS by_day FROM orders""")
def partial_date_compare(t):
    d = C.partial_date(F.date_format("o_orderdate", "yyyy-MM-dd"))
    against = lambda text, op: C.date_compare(d, C.partial_date(F.lit(text)), op)
    return t("orders").select("o_orderkey", against("xx-06-xx", ">=").alias("by_month"), against("1995-xx-xx", ">").alias("by_year"), against("1996-06-15", "<=").alias("by_day"))

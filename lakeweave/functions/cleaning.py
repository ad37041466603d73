"""Scalar cleaning: values, keys, names, addresses, partial dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three null vocabularies, which are not the same.
OVERLAP_NULLS = ["", "nan", "none", "null", "n/a", "na"]
TFIDF_NULLS = ["", "nan", "none", "null", "n/a", "na", "-", "--"]
ENRICH_NULLS = ["", "nan", "none"]

SPACE = "[\\t\\n\\x0B\\f\\r ]+"


def strip(c: Column) -> Column:
    """Both ends without white space, by an explicit class: trim() knows the blank alone."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}", ""), f"{SPACE}$", "")


def normalize_value(c: Column, nulls: list[str] = OVERLAP_NULLS) -> Column:
    v = F.lower(strip(c))
    return F.when(v.isin(nulls), F.lit(None)).otherwise(v)


def normalize_key(c: Column) -> Column:
    """As a value, but a null stays as the text nan."""
    return F.lower(strip(F.coalesce(c, F.lit("nan"))))


def column_name(c: Column) -> Column:
    return F.translate(c, "\r\n", "")


def plain_name(c: Column) -> Column:
    """Lower case, without quotes, line ends and commas."""
    return F.lower(F.translate(c, "\"'\r\n,", ""))


def file_stem(c: Column) -> Column:
    """The last part of a path, without .gz, .bz2 and .csv at its end."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.(gz|bz2)$", ""), r"\.csv$", "")


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def csv_escape(c: Column) -> Column:
    return F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def tsv_unescape(c: Column) -> Column:
    """Back from \\n, \\p (a pipe) and \\\\."""
    mark = "\u0001"
    out = F.replace(c, F.lit("\\\\"), F.lit(mark))
    out = F.replace(F.replace(out, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|"))
    return F.replace(out, F.lit(mark), F.lit("\\"))


def number(c: Column) -> Column:
    """A number behind currency, thousands and percent signs, else null."""
    return F.translate(strip(c), ",$%", "").try_cast("double")


def url_kind(url: Column) -> Column:
    """The connector that reads an address: direct (a file), ckan, socrata or generic."""
    path = F.regexp_extract(F.lower(url), r"^[a-z]+://[^/]+(/[^?#]*)?", 1)
    return (
        F.when(path.rlike(r"\.(csv|tsv|json|xlsx?|zip|gz)$"), "direct")
        .when(path.rlike(r"^/dataset/|/api/3/action/"), "ckan")
        .when(path.rlike(r"/resource/[a-z0-9]{4}-[a-z0-9]{4}|/d/[a-z0-9]{4}-[a-z0-9]{4}"), "socrata")
        .otherwise("generic")
    )


def partial_date(c: Column) -> Column:
    """struct(y, m, d) of y-m-d, where xx parts and what is missing are -1; null if it is no date."""
    part = lambda i: F.when(F.regexp_extract(c, PARTIAL, i).rlike("^[0-9]+$"), F.regexp_extract(c, PARTIAL, i).cast("int")).otherwise(-1)
    y, m, d = part(1), part(2), part(3)
    ok = c.rlike(PARTIAL) & ((m == -1) | m.between(1, 12)) & ((d == -1) | d.between(1, 31)) & ((y > -1) | (m > -1) | (d > -1))
    return F.when(ok, F.struct(y.alias("y"), m.alias("m"), d.alias("d")))


PARTIAL = "^([0-9]{4}|xx|xxxx)-([0-9]{1,2}|xx)-([0-9]{1,2}|xx)$"


def date_order(d: Column) -> Column:
    return 365 * d["y"] + 30 * d["m"] + d["d"]


def date_ge_each(a: Column, b: Column) -> Column:
    """a >= b as whole dates, and in the month and in the day too: what the third kind of date compares."""
    return (F.struct(a["y"], a["m"], a["d"]) >= F.struct(b["y"], b["m"], b["d"])) & (a["m"] >= b["m"]) & (a["d"] >= b["d"])


def date_compare(a: Column, b: Column, op: str) -> Column:
    """a op b, where the right side says what is compared: its month or year alone, if it has nothing else."""
    do = {">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y}[op]
    month = (b["y"] == -1) & (b["m"] > -1) & (b["d"] == -1)
    year = (b["y"] > -1) & (b["m"] == -1) & (b["d"] == -1)
    return F.when(month, do(a["m"], b["m"])).when(year, do(a["y"], b["y"])).otherwise(do(date_order(a), date_order(b)))

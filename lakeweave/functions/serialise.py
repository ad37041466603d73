"""Rows, columns and tables as text; tokens, vocabularies and weights."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_text(columns: list[str], cut: int = 100) -> Column:
    """``name: value`` of each column, joined by `` | ``; values cut at ``cut`` characters, nulls empty."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, cut)) for c in columns])


def table_text(df: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Header and rows joined by pipes, rows by `` . ``; one small table a group."""
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))).alias("r"))
    return rows.select(by, F.concat_ws(" . ", F.lit(" | ".join(columns)), F.array_join(F.transform("r", lambda x: x["t"]), " . ")).alias("text"))


def column_text(cells: DataFrame, most: int = 50) -> DataFrame:
    """The header, unless it is generic, and the first ``most`` known values of each column (table_id, col, row_idx, value)."""
    w = Window.partitionBy("table_id", "col").orderBy("row_idx")
    few = cells.filter(F.col("value").isNotNull()).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    text = few.groupBy("table_id", "col").agg(F.array_sort(F.collect_list(F.struct("_n", "value"))).alias("v"))
    generic = F.lower("col").rlike("^(col|column|field|unnamed)?[ _:]*[0-9]*$")
    body = F.array_join(F.transform("v", lambda x: x["value"]), ", ")
    return text.select("table_id", "col", F.when(generic, body).otherwise(F.concat(F.col("col"), F.lit(": "), body)).alias("text"))


def column_types(cells: DataFrame) -> DataFrame:
    """integer, float, date or string for each column: the narrowest type that all known values have."""
    v = F.col("value")
    known = cells.filter(v.isNotNull()).groupBy("table_id", "col").agg(
        F.every(v.rlike("^[+-]?[0-9]+$")).alias("i"), F.every(v.try_cast("double").isNotNull()).alias("f"), F.every(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")).alias("d")
    )
    return known.select("table_id", "col", F.when(F.col("i"), "integer").when(F.col("f"), "float").when(F.col("d"), "date").otherwise("string").alias("type"))


def vocabulary(words: DataFrame, word: str, most: int, least: int) -> DataFrame:
    """Words of ``least`` counts or more, the ``most`` most frequent ones numbered from 0 (ties by the word)."""
    n = words.groupBy(word).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    top = n.orderBy(F.col("n").desc(), word).limit(most)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.col("n").desc(), word)) - 1).cast("long"))


def token_sample(docs: DataFrame, key: str, text: str, how: str, most: int, seed: str = "token") -> DataFrame:
    """(key, tokens): up to ``most`` tokens (lower case, between blanks) of each text, in one of the ways of choosing.

    head: the first; alpha_head: the first distinct ones by the alphabet; nth: every n-th, so that the whole text is spanned;
    random: those whose hashes with their place are least, in the text's order. All are array expressions: no shuffle.
    """
    words = F.array_remove(F.split(F.lower(text), "[ \\t\\n\\r\\f\\x0B]+"), "")
    step = F.greatest(F.lit(1), F.floor(F.size("w") / most).cast("int"))
    if how == "head":
        out = F.slice("w", 1, most)
    elif how == "alpha_head":
        out = F.slice(F.array_sort(F.array_distinct("w")), 1, most)
    elif how == "nth":
        out = F.slice(F.filter("w", lambda x, i: i % step == 0), 1, most)
    elif how == "random":
        dealt = F.transform("w", lambda x, i: F.struct(F.xxhash64(F.lit(seed), i, x).alias("h"), i.alias("i"), x.alias("x")))
        out = F.transform(F.array_sort(F.transform(F.slice(F.array_sort(dealt), 1, most), lambda s: F.struct(s["i"], s["x"]))), lambda s: s["x"])
    else:
        raise ValueError(f"no such sample: {how}")
    return docs.select(key, words.alias("w")).select(key, out.alias("tokens"))


def pmi_sample(cells: DataFrame, table: str, order: str, topic: str, prop: str, most: int, of_topic: bool = False) -> DataFrame:
    """(table, place, token): words of a column's values, those most bound to the topic column's first, by n(topic, value) / (n(topic) n(value)).

    Counts are over all tables. A value's words all go in while fewer than ``most`` stand; each word stands once a table. Equal pairs go by their first row.
    """
    value = topic if of_topic else prop
    known = cells.filter(F.col(topic).isNotNull() & F.col(prop).isNotNull())
    both = known.groupBy(topic, prop).agg(F.count("*").alias("_b"))
    score = both.join(both.groupBy(topic).agg(F.sum("_b").alias("_t")), topic).join(both.groupBy(prop).agg(F.sum("_b").alias("_p")), prop)
    score = score.select(topic, prop, (F.col("_b") / (F.col("_t") * F.col("_p"))).alias("_s"))
    pairs = known.groupBy(table, topic, prop).agg(F.min(order).alias("_o")).join(score, [topic, prop])
    word = pairs.select(table, "_s", "_o", F.posexplode(F.split(F.col(value).cast("string"), " ")).alias("_i", "token"))
    first = word.groupBy(table, "token").agg(F.min(F.struct(-F.col("_s"), F.col("_o"), F.col("_i"))).alias("_at"))
    # a word is in if fewer than ``most`` new words stood before its value began
    ranked = first.select(table, "token", F.row_number().over(Window.partitionBy(table).orderBy("_at")).alias("place"), "_at")
    upto = ranked.withColumn("_before", F.min("place").over(Window.partitionBy(table, F.col("_at.col1"), F.col("_at._o"))) - 1)
    return upto.filter(F.col("_before") < most).select(table, "place", "token")


def capped(postings: DataFrame, most: int) -> DataFrame:
    """The postings of the ``most`` words that are in the most documents; ties go to the first by name."""
    held = postings.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most).select("w")
    return postings.join(held, "w", "left_semi")


def tf_idf(postings: DataFrame, key: str) -> DataFrame:
    """(1 + ln tf) * (ln((1 + docs) / (1 + df)) + 1), each document's weights of length 1."""
    docs = postings.select(key).distinct().count()
    df = postings.groupBy("w").agg(F.count("*").alias("df"))
    x = postings.join(df, "w").withColumn("x", (1 + F.log("tf")) * (F.log((1 + F.lit(docs)) / (1 + F.col("df"))) + 1))
    length = x.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return x.join(length, key).select(key, "w", F.round(F.col("x") / F.col("l"), 6).alias("weight"))


#: Characters that count as one quote, as double quotes and as a hyphen, and the marks of notes.
QUOTES, DOUBLE_QUOTES, DASHES, MARKS = "\u2018\u2019\u00b4`", "\u201c\u201d", "\u2010\u2011\u2012\u2013\u2014\u2212", "\u2022\u2666\u2020\u2021*#+"
#: What may stand at an answer's end and says nothing: marks, numbered notes, and notes in brackets that do not begin it.
_TAIL = "(?:[" + MARKS + r"\s]|\[[0-9]+\]|(?!\A)(?:\[[^\]]*\]| \([^)]*\)))+\z"


def decomposed(c: Column) -> Column:
    """Compatibility decomposition without combining marks; ASCII stays in the JVM, and of other texts only what is not ASCII is looked up.

    A function in Python gets every row, whatever condition it stands behind, so that ASCII texts go there as nulls.
    """
    other = re.compile(r"[^\x00-\x7F]+")  # ASCII is its own decomposition, and no mark moves across it

    def plain(m: re.Match) -> str:
        return "".join(ch for ch in unicodedata.normalize("NFKD", m[0]) if unicodedata.category(ch) != "Mn")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([other.sub(plain, x) if x is not None else None for x in s], dtype=object)

    return F.coalesce(run(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def normal_answer(c: Column) -> Column:
    """Answers made comparable: accents off, one kind of quotes and hyphens, no notes at the end, no quotes around the whole.

    What is within quotes around the whole has none itself, so that its end is cleaned once more and nothing is left to do.
    """
    same = F.translate(decomposed(c), QUOTES + DOUBLE_QUOTES + DASHES, "'" * len(QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES))
    trimmed = lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r"))
    # only what ends in a mark or a bracket has a tail: no search through the others; the array holds the text, so that it is made once
    ends = lambda x: F.right(x, F.lit(1)).rlike("[" + MARKS + r"\])]")
    cut = lambda x: F.transform(F.array(x), lambda y: F.when(ends(y), F.regexp_replace(y, _TAIL, "")).otherwise(y))[0]
    cleaned = lambda x: trimmed(cut(trimmed(x)))
    inner = cleaned(F.regexp_replace(cleaned(same), r'\A"([^"]*)"\z', "$1"))
    return trimmed(F.lower(F.regexp_replace(F.regexp_replace(inner, r"\.\z", ""), r"\s+", " ")))

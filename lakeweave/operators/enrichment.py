"""Enrichment of a query table: union with one candidate, then join with another, then scores against the parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.cleaning import ENRICH_NULLS, normalize_key, normalize_value

from .lake import append_aligned, enrich, multiset_f1


def new_rows(query: DataFrame, candidate: DataFrame, query_key: str, candidate_key: str) -> DataFrame:
    """Rows of the candidate whose normalised key the query table lacks."""
    known = query.select(normalize_key(F.col(query_key).cast("string")).alias("_k")).distinct()
    return candidate.withColumn("_k", normalize_key(F.col(candidate_key).cast("string"))).join(known, "_k", "left_anti").drop("_k")


def enrich_table(query: DataFrame, union: DataFrame | None, join: DataFrame | None, alignment: dict[str, str], query_key: str, join_key: str) -> DataFrame:
    """Union by aligned columns with new rows, then a left join; appended rows take part in the join as the others do."""
    out = query
    if union is not None:
        out = append_aligned(out, new_rows(query, union, query_key, alignment[query_key]), alignment)
    return enrich(out, join, query_key, join_key) if join is not None else out


def bag(df: DataFrame, columns: list[str]) -> DataFrame:
    """All normalised cell values of the columns, as a bag."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], columns, "c", "v").select(normalize_value(F.col("v"), ENRICH_NULLS).alias("v")).filter(F.col("v").isNotNull())


def cell_f1(enriched: DataFrame, parent: DataFrame, enriched_columns: list[str], parent_columns: list[str]) -> DataFrame:
    return multiset_f1(bag(enriched, enriched_columns), bag(parent, parent_columns), "v")

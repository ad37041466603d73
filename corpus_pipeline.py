"""From raw documents to digests of their tokens: quality rules, line dedup, near-dedup, mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm import bpe, line_dedup, mixing, near_dedup, quality
from lakeweave.llm._common import documents, stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts among them, and those with a null id like any other.

    Texts of any length are judged whole; rows are judged alone, so repeated rows share a fate and ties need no rule; an empty table stays
    empty; all columns stay, whatever their names.
    """
    return quality.accepted(docs, documents(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go; documents stay, those without a line left as empty texts, and null texts as they are.

    Earlier is by id, then by line; rows with null or repeated ids are told apart by numbers of their own, which settles ties. Texts of any
    length are cut whole; an empty table stays empty; all columns stay, whatever their names.
    """
    return line_dedup.line_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id; null ids come last, and of repeated ids the first number stays.

    Null texts, empty texts and those without words are in no group and stay. Texts of any length count whole; an empty table stays empty; all
    columns stay, whatever their names.
    """
    return near_dedup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once or more, sources in their target weights; a null source is a source.

    Null and empty texts have no tokens and come once. Rows with the same id are told apart by all their columns, and equal rows by
    number; documents of any length count whole; an empty table stays empty; all columns stay, whatever their names.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, repeated rows each; a null text is the empty one, a null id stays null.

    Texts of any length are encoded whole; an empty table gives an empty result; other columns are left out.
    """
    import public_tokenizers

    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("line dedup", lines), ("near dedup", near_copies), ("mixing", mix), ("bpe", encode)]
ORACLE_SQL = None  # no stage but the first could be put in SQL; tests/llm has brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stash(docs) if k < len(STAGES) - 1 else docs
    return docs

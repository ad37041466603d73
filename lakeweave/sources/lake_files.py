"""Cells of whole lakes of delimited files, cut into records in parallel within each file, and cells of workbooks.

A quoted value may hold line ends, so whether a line begins a record depends on all quotes before it in the file. Lines are read in Hadoop's splits,
from any store; each split adds up its quotes and, for either state in which it may begin, the records that begin in it. Sums over
the splits of a file, a row for each, tell every split its state and the number of its first record. No file is one task, and no line is read in
another order than the file's.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "table_id string, row_idx long, col_idx int, col string, value string"
AT = ["path", "split"]


def records(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(path, n, record): the records of all files, numbered from 0; a record's lines are put together again. A file that is no UTF-8 has none."""
    read = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    lines = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    before = Window.partitionBy(*AT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # within one split
    lines = lines.withColumn("_q", quotes).withColumn("_odd", F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2)
    splits = lines.groupBy(*AT).agg((F.sum("_q") % 2).alias("_flip"), F.count_if(F.col("_odd") == 0).alias("_even"), F.count_if(F.col("_odd") == 1).alias("_uneven"), F.bool_and(F.is_valid_utf8("value")).alias("_text"))
    splits = splits.withColumn("_text", F.min("_text").over(Window.partitionBy("path"))).filter("_text")
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.withColumn("_state", F.coalesce(F.sum("_flip").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("_begun", F.when(F.col("_state") == 0, F.col("_even")).otherwise(F.col("_uneven"))).withColumn("_base", F.coalesce(F.sum("_begun").over(earlier), F.lit(0)))
    x = lines.join(splits.select(*AT, "_state", "_base"), AT).withColumn("_starts", ((F.col("_odd") + F.col("_state")) % 2 == 0).cast("int"))
    upto = Window.partitionBy(*AT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("n", F.col("_base") + F.sum("_starts").over(upto) - 1)
    parts = x.groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("l"))  # the lines of one record
    return parts.select("path", "n", F.array_join(F.transform("l", lambda y: y["value"]), "\n").alias("record"))


def fields(rows: DataFrame) -> DataFrame:
    """``rows`` (path, n, record) with ``fields``, the record's values; records that are not well formed have none."""

    def cut(text: str | None) -> list[str] | None:
        try:
            found = list(csv.reader(io.StringIO(text or "", newline="")))
        except csv.Error:
            return None
        return found[0] if len(found) == 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([cut(x.as_py()) for x in b.column(2)], pa.list_(pa.string()))], names=["path", "n", "fields"])

    return rows.select("path", "n", "record").mapInArrow(run, "path string, n long, fields array<string>")


def cells(rows: DataFrame) -> DataFrame:
    """Cells of ``rows`` (path, n, fields), the first row of each file being its header.

    A ragged row is cut to its header; a name that occurred before gets its column's number; empty lines have no row but their number.
    """
    mark = F.regexp_replace(F.get("fields", F.lit(0)), "^\\ufeff", "")
    head = rows.filter("n = 0").select("path", F.concat(F.array(mark), F.slice("fields", 2, F.greatest(F.size("fields") - 1, F.lit(0)))).alias("_h"))
    named = F.transform("_h", lambda c, i: F.when(F.array_contains(F.slice("_h", 1, i), c), F.concat_ws("_", c, i.cast("string"))).otherwise(c))
    head = head.select("path", named.alias("_h"))
    x = rows.filter("n > 0 and size(fields) > 0").join(head, "path")
    each = F.slice(F.arrays_zip(F.col("_h").alias("col"), F.col("fields").alias("value")), 1, F.least(F.size("_h"), F.size("fields")))
    file = F.regexp_extract(F.url_decode("path"), "([^/]*)$", 1)
    out = x.select(file.alias("table_id"), (F.col("n") - 1).alias("row_idx"), F.posexplode(each).alias("col_idx", "x"))
    return out.select("table_id", "row_idx", "col_idx", F.col("x.col").alias("col"), F.col("x.value").alias("value"))


NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheets(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the filled cells of one workbook, rows and columns from 0."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", NS)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", NS):
            target = targets[s.get(REL)].lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            for cell in ElementTree.fromstring(z.read(target)).iter(f"{{{NS['m']}}}c"):
                kind, value = cell.get("t"), cell.find("m:v", NS)
                text = "".join(t.text or "" for t in cell.iter(f"{{{NS['m']}}}t")) if kind == "inlineStr" else value.text if value is not None else None
                if text is None or (at := re.fullmatch("([A-Z]+)([0-9]+)", cell.get("r", ""))) is None:
                    continue
                col = 0
                for c in at[1]:
                    col = 26 * col + ord(c) - 64
                yield s.get("name"), int(at[2]) - 1, col - 1, shared[int(text)] if kind == "s" else text


def read_workbooks(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """Cells of all sheets of all workbooks: table_id is file and sheet, the first row of a sheet its header. A workbook is
    one zip and is read whole, many abreast; one that cannot be read has no cells."""
    rows = "path string, n long, col_idx int, value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                try:
                    found = [(f"{name.as_py()}#{s}", r, c, v) for s, r, c, v in sheets(content.as_py())]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError):
                    found = []
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["path", "n", "col_idx", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    x = files.mapInArrow(run, rows)
    head = x.filter("n = 0").select("path", "col_idx", F.col("value").alias("col"))
    out = x.filter("n > 0").join(head, ["path", "col_idx"])
    return out.select(F.regexp_extract("path", "([^/]*)$", 1).alias("table_id"), (F.col("n") - 1).alias("row_idx"), "col_idx", "col", "value")


def read_lake(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """cells (table_id, row_idx, col_idx, col, value) of all delimited files under ``path``, whatever their columns."""
    return cells(fields(records(spark, path, pattern)))

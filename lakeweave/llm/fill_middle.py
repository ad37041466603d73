"""Fill-in-the-middle transformation of whole texts.

Each text is decoded to an array of code points. Where a code point is no ASCII letter, or its left neighbour is none, a
token begins: comparing the classes of neighbours and ``flatnonzero`` give all boundaries at once. Two numbers from a
digest of the document's id pick the boundaries where the prefix and the middle end; the array is sliced there, and the
slices are encoded again. The order of the pieces (suffix first or prefix first) and whether a text stays plain come from
the same digest, so a document is cut alike wherever and whenever it is read. ``restored`` undoes it from output and form.

Defined cases: a null text is the empty text, which stays plain; a null id is digested as no digits; a text that holds one
of the marks stays plain, as its pieces could not be told apart; bytes that are no UTF-8 count as one code point each and
come back unchanged; rows are cut each alone, so repeated rows get equal results and ties need no rule; texts of any length
are cut whole; an empty table gives an empty result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, spread

PRE, SUF, MID = "<P>", "<S>", "<M>"
SEED, CHANGED, SPM = 1, 90, 20  # the digest's salt; of 100 texts so many are cut, and of 100 cut ones so many suffix first
FLUSH = 4 << 20  # bytes of output in one Arrow batch, or one text


def code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def encoded(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where tokens ``[A-Za-z]+|[^A-Za-z]`` begin."""
    folded = points | np.uint32(32)
    letter = (folded >= 97) & (folded <= 122)
    begins = ~letter
    if len(points):
        begins[0] = True
        begins[1:] |= ~letter[:-1]
    return np.flatnonzero(begins)


def cut(doc_id: object, text: bytes, seed: int = SEED, changed: int = CHANGED, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of tokens, form, code points of prefix and middle (none if plain), output."""
    digits = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    points = code_points(text)
    starts = boundaries(points)
    n = len(starts)
    if not n or h3 % 100 >= changed or any(m.encode() in text for m in (PRE, SUF, MID)):
        return n, "plain", None, None, text
    a, b = (int(starts[k]) if k < n else len(points) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (encoded(x) for x in (points[:a], points[a:b], points[b:]))
    p, s, m = PRE.encode(), SUF.encode(), MID.encode()
    if h4 % 100 < spm:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, b - a, p + prefix + s + suffix + m + middle


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, changed: int = CHANGED, spm: int = SPM) -> DataFrame:
    """A row for each document: id, n, form (plain, psm, spm), prefix_chars, middle_chars, output (the text as bytes of UTF-8)."""
    kind = docs.schema[id_col].dataType.simpleString()
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, size, rows = 0, 0, []
            for i, (key, text) in enumerate(zip(b.column(0), b.column(1), strict=True)):
                rows.append(cut(key.as_py(), text.as_py() or b"", seed, changed, spm))
                size += len(rows[-1][-1])
                if size >= FLUSH or i == b.num_rows - 1:
                    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), *columns], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    first, size, rows = i + 1, 0, []

    own = spread(docs.select(F.col(id_col), F.col(text_col).cast("binary")))
    return own.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")


def restored(output: Column, form: Column) -> Column:
    """The text as bytes, from output (binary) and form alone.

    No text that was cut holds a mark, so each mark is found where it was put. Read as Latin-1 every byte is one character.
    """
    text = F.decode(output, "ISO-8859-1")

    def between(a: str, b: str) -> Column:
        """What lies between the marks; ``a`` stands before ``b``."""
        at = F.locate(a, text) + len(a)
        return F.substring(text, at, F.locate(b, text) - at)

    last = F.substring(text, F.locate(MID, text) + len(MID), F.length(text))
    psm = F.concat(between(PRE, SUF), last, between(SUF, MID))
    spm = F.concat(between(PRE, MID), last, between(SUF, PRE))
    back = lambda c: F.encode(c, "ISO-8859-1")
    return F.when(form == "psm", back(psm)).when(form == "spm", back(spm)).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(documents(spark, sf_dir))
    back = restored(F.col("output"), F.col("form"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT doc_id, text, [('0x' || h[8 * i + 1 : 8 * i + 8])::BIGINT FOR i IN range(4)] AS h, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t FROM d),
n AS (SELECT doc_id, text, t, len(t) AS n, h[1] % (len(t) + 1) AS a, h[2] % (len(t) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '{PRE}') OR contains(text, '{SUF}') OR contains(text, '{MID}') OR h[3] % 100 >= {CHANGED} THEN 'plain'
    WHEN h[4] % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, array_to_string(t[: least(a, b)], '') AS x, array_to_string(t[least(a, b) + 1 : greatest(a, b)], '') AS y,
  array_to_string(t[greatest(a, b) + 1 :], '') AS z FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PRE}' || x || '{SUF}' || z || '{MID}' || y ELSE '{SUF}' || z || '{PRE}' || x || '{MID}' || y END) AS output_sha256,
  sha256(x || y || z) AS restored_sha256 FROM p
"""

"""Byte-level BPE encoding and decoding by a given table of ranks.

Each match of the split pattern is encoded alone. A segment tree over the byte positions of the match holds, for each
live position, the rank of the pair that starts there; its root is the leftmost of the lowest ranks. A merge updates the
leaves of the merged position, its right neighbour and its left neighbour, each in logarithmic time.

Defined cases: a null text is the empty text (no tokens); any bytes can be encoded, texts of any length too; rows are
encoded one by one, so repeated rows and ties need no rule; an empty table gives an empty result; other columns are left out,
whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, spread

NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: again and again the leftmost pair of the lowest rank is merged."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    leaves = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * leaves)
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[leaves + i] = r * n + i  # the order of these is by rank, then by place
    for i in range(leaves - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # of the token that starts here
    left = list(range(-1, n - 1))

    def put(at: int, key: int) -> None:
        at += leaves
        tree[at] = key
        while at > 1:
            other = tree[at ^ 1]
            at >>= 1
            low = key if key < other else other
            if tree[at] == low:
                return
            tree[at] = key = low

    def pair(at: int) -> int:
        middle = end[at]
        if middle >= n:
            return NONE
        r = ranks.get(piece[at : end[middle]])
        return NONE if r is None else r * n + at

    while tree[1] != NONE:
        at = tree[1] % n
        gone = end[at]
        end[at] = end[gone]
        if end[at] < n:
            left[end[at]] = at
        put(gone, NONE)
        put(at, pair(at))
        if left[at] >= 0:
            put(left[at], pair(left[at]))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Codec:
    """Encodes and decodes; pieces seen lately are remembered in two generations of bounded size."""

    LIMIT = 250_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.young: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else merge(raw, self.ranks)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split.findall(text) for i in self.encode_piece(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def known(self, piece: str) -> tuple[str, int, bytes]:
        """The ids of a piece in decimal, their number, and the bytes that they decode to."""
        if (got := self.old.get(piece)) is None:
            ids = self.encode_piece(piece)
            got = " ".join(map(str, ids)), len(ids), self.decode(ids)
        if len(piece) < 64:
            if len(self.young) >= self.LIMIT:
                self.young, self.old = {}, self.young
            self.young[piece] = got
        return got

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by a space, SHA-256 of the bytes decoded from them."""
        pieces = self.split.findall(text)
        find, make = self.young.get, self.known
        found = [find(p) or make(p) for p in pieces]
        ids = " ".join([x[0] for x in found])
        return sum([x[1] for x in found]), sha256(ids.encode()).hexdigest(), sha256(b"".join([x[2] for x in found])).hexdigest()


_CODECS: dict[str, Codec] = {}


def codec(name: str, ranks: dict[bytes, int], pattern: str) -> Codec:
    """The codec of a worker process: what one task has learned serves the next."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(ranks, pattern)
    return _CODECS[name]


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256. The table of ranks, of a fixed size, is broadcast."""
    spark = docs.sparkSession
    table = read_ranks(ranks_path)
    name = sha256(repr((pattern, sorted(table.items()))).encode()).hexdigest()
    ranks = spark.sparkContext.broadcast(table)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, ranks.value, pattern)
        for b in batches:
            rows = [own.digest(str(x.as_py() or b"", "utf-8", "replace")) for x in b.column(1)]
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["id", "n", "i", "d"])

    own = spread(docs.select(F.col(id_col), F.col(text_col).cast("binary")))
    return own.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

"""Secret scans by one combined deterministic automaton.

The shortest matches of all rules are compiled to one minimal automaton that reads backwards. A single pass over the
bytes, many lines abreast, from their ends to their beginnings, gives the places where a match of each rule begins; no rule
crosses a line feed. From the leftmost of these the rule's own transition array runs on to the longest match, and the next
one begins behind it: leftmost, longest, not overlapping within a rule. A match that is too short is passed over whole, as if
it had been found, and then dropped. Every byte is read once backwards, and those of matches once more for each rule.

Defined cases: a null text is the empty text and has no spans; spans count code points; each row is scanned alone, so
repeated rows and ties need no rule; texts and lines may have any length, and the time grows with it in proportion; an empty
table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, spread
from .automaton import Machine

_LEAD = r"(password|passwd|secret|token|api_?key)"
_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
#: kind, before the value, value, is the lead in either case, least length of the whole match, least length of the value
RULES = [
    ("assign", None, r"[A-Za-z0-9+/_.=-]", True, 0, 12),
    ("access", "AKIA", "[A-Z0-9]", False, 18, 0),
    ("hex", "[0-9a-f]{15}", "[0-9a-f]", False, 16, 0),
    ("hub", "gh[opsru]_", "[A-Za-z0-9]", False, 40, 0),
    ("chat", "xox[abprs]-", "[A-Za-z0-9-]", False, 20, 0),
    ("maps", "AIza", "[A-Za-z0-9_-]", False, 39, 0),
    ("web", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", False, 40, 0),
    ("pem", "-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY----", "-", False, 0, 0),
]
KINDS = [r[0] for r in RULES]
BASE = KINDS[:3]


class Scanner:
    def __init__(self) -> None:
        folded = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in _LEAD)
        leads = [(folded + _SIGN) if lead is None else lead for _, lead, *_ in RULES]
        heads = [f"{lead}{value}" for lead, (_, _, value, *_) in zip(leads, RULES, strict=True)]
        self.all = Machine([(head, False) for head in heads], backwards=True)
        self.whole = [Machine([(head if kind == "pem" else f"{head}+", False)]) for head, (kind, *_) in zip(heads, RULES, strict=True)]
        self.lead = [Machine([(lead, False)]) for lead in leads]

    def rule_spans(self, text: bytes, places: list[int], rule: int) -> list[tuple[int, int]]:
        """The rule's spans in bytes; a match begins at each of ``places``, and nowhere else."""
        machine, (_, _, _, _, least, value) = self.whole[rule], RULES[rule]
        out, free = [], 0
        for at in places:
            if at < free:
                continue
            free = end = machine.longest(text, at)
            if end - at >= least and (not value or end - self.lead[rule].longest(text, at) >= value):
                out.append((at, end))
        return out

    def batch(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end) in code points, in order."""
        joined = b"\n".join(texts)
        breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10) if joined else np.empty(0, np.int64)
        starts = np.concatenate([[0], breaks + 1])
        places, masks = self.all.begins(joined, starts, np.concatenate([breaks, [len(joined)]]) - starts)
        firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k in range(len(RULES)):
            for a, b in self.rule_spans(joined, places[(masks >> k & 1) > 0].tolist(), k):
                doc = int(np.searchsorted(firsts, a, "right")) - 1
                out[doc].append((a - int(firsts[doc]), k, b - int(firsts[doc])))
        return [sorted(self.points(t, x)) if x else x for t, x in zip(texts, out, strict=True)]

    @staticmethod
    def points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of bytes as spans of code points."""
        if text.isascii():
            return spans
        of = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        return [(int(of[a]), k, int(of[b])) for a, k, b in spans]


@cache
def scanner() -> Scanner:
    """The scanner of a worker, kept between its tasks."""
    return Scanner()


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and spans, an array of (kind, start, end) by start, then kind as listed in RULES."""
    kind = docs.schema[id_col].dataType.simpleString()
    chunk = 8 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner()
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            texts, found, size = [], [], 0
            for x in b.column(1):
                texts.append(x.as_py() or b"")
                size += len(texts[-1])
                if size >= chunk:
                    found += own.batch(texts)
                    texts, size = [], 0
            if texts:
                found += own.batch(texts)
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, shape)], names=["id", "spans"])

    own = spread(docs.select(F.col(id_col), F.col(text_col).cast("binary")))
    return own.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long>>")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))

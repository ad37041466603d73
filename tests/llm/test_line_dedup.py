import random
from collections import Counter

import pytest

from lakeweave.llm import line_dedup

from . import odd


def distance_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows, least=1):
    """The (row, line) that go; rows are (id, text), told apart by their number."""
    lines = []
    for n, (i, t) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0])):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            w = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in line.lower()).split(" ")
            lines.append((n, k, [x for x in w if x]))
    gone = set()
    for at, (n, k, w) in enumerate(lines):
        if len(w) >= least and any(w == v or (min(len(w), len(v)) >= 8 and distance_within_one(w, v)) for _, _, v in lines[:at]):
            gone.add((n, k))
    return gone


def without(rows, gone):
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (n, k) not in gone)) for n, (i, t) in enumerate(rows)]


def test_edit_distance_by_brute_force():
    assert distance_within_one([1, 2, 3], [1, 3]) and distance_within_one([1, 2, 3], [1, 9, 3]) and distance_within_one([1], [1])
    assert not distance_within_one([1, 2, 3], [2, 3, 1]) and not distance_within_one([1, 2], [1, 2, 3, 4])


def table():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    bases = [[r.choice(vocab) for _ in range(n)] for n in (3, 5, 7, 8, 9, 15, 16, 17, 18, 40, 130, 300) for _ in range(3)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(1, 6)):
            w = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at, kind = r.randrange(len(w)), r.randrange(3)
                w[at : at + 1] = [[], [r.choice(vocab)], [w[at], r.choice(vocab)]][kind]
            lines.append(r.choice(["", " "]) + r.choice([" ", "\t "]).join(w).title())
        rows.append((i, "\n".join(lines)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("least", [1, 5])
def test_lines_equal_brute_force(spark, least):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = [i for i, _ in rows]
    assert {(x._id, x._line) for x in line_dedup.decided(docs, least=least).collect()} == {(ids[n], k) for n, k in brute(rows, least)}


def test_odd_rows(spark):
    rows = [x[:2] for x in odd.rows()]
    docs = odd.documents(spark)  # null and repeated ids
    out = line_dedup.line_dedup(docs)
    assert out.columns == docs.columns
    assert Counter((x.doc_id, x.text) for x in out.collect()) == Counter(without(rows, brute(rows)))
    assert line_dedup.line_dedup(odd.empty(spark)).count() == 0


def test_documents_without_ids_keep_their_own_lines(spark):
    rows = [(None, "a b\nc d\ne f"), (None, "a b\nother line\nlast of all"), (None, "x\nc d\nunique")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.text for x in out.collect()) == sorted(t for _, t in without(rows, brute(rows)))

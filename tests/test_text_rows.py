"""Words of documents are counted row by row: what is shuffled are figures, not words."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import lake as L
from lakeweave.operators import retrieval as R

from .test_retrieval import plain


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_minhash_sorts_no_words(spark):
    """minima of texts were sorted and spilled word by word. Rows of one id make one set; empty and null ones have no row."""
    rows = [(1, "a b"), (1, "c a"), (2, "Zoo"), (3, "  "), (4, None), (None, "x")]
    words = F.array_remove(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+")), "")
    out = L.minhash(spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", words.alias("w")), ["doc_id"], "w", 6)
    assert "SortAggregate" not in plan(out) and "Generate" not in plan(out)
    least = lambda ws, i: min(int(hashlib.md5(f"{i // 4}:{w}".encode()).hexdigest()[8 * (i % 4) : 8 * (i % 4) + 8], 16) for w in ws)
    want = {(k, *(least(ws, i) for i in range(6))) for k, ws in ((1, "abc"), (2, ["zoo"]), (None, "x"))}
    assert set(map(tuple, out.collect())) == want


def texts():
    """Many ties, copies, repeated and null ids, texts that are empty or null."""
    r = random.Random(11)
    some = lambda n: " ".join(f"w{int(r.paretovariate(0.8))}" for _ in range(n))
    rows = [(i, some(r.randint(0, 40))) for i in range(300)] + [(400 + i, "Red w1, w2") for i in range(50)]
    return [*rows, (7, "red red w3"), (7, None), (9, "w1"), (500, ""), (501, None), (None, "w1 blue"), (None, "red w9")]


QUESTIONS = {1: "red w1", 2: "blue blue w2 w1", 3: "w3 w7 w1", 4: "nowhere", 5: "w1", 6: "w2 red w5 w4"}


def sides(spark):
    docs = spark.createDataFrame(texts(), "id long, text string").repartition(5)
    return R.postings(spark.createDataFrame(list(QUESTIONS.items()), "qid long, text string"), "qid", "text", " "), R.words_of(docs, "id", "did")


def merged():
    out = {}
    for i, x in texts():
        out[i] = out.get(i, "") + " " + (x or "").lower().replace(",", "")
    return out


def by_query(rows):
    out = {}
    for x in sorted(rows, key=lambda x: (x.qid, x["rank"])):
        out.setdefault(x.qid, []).append(x.did)
    return out


@pytest.mark.parametrize("how", ["dirichlet", "jelinek_mercer"])
def test_query_likelihood_by_products(spark, how, monkeypatch):
    """postings were written and joined again and again. A null id is no document, but its words count in the collection."""
    monkeypatch.setattr(R, "QUERIES", 4)
    queries, docs = sides(spark)
    out = R.query_likelihood(queries, docs, how, 4)
    assert "w#" not in plan(out)
    every = plain(QUESTIONS, {-1 if i is None else i: x for i, x in merged().items()}, how, 1000)
    assert by_query(out.collect()) == {q: [d for d in ds if d >= 0][:4] for q, ds in every.items() if ds}


def test_overlaps_by_products(spark, monkeypatch):
    """a row was made for each word that a query and a document share. A null id is a document, and the last of equals."""
    monkeypatch.setattr(R, "QUERIES", 4)
    queries, docs = sides(spark)
    out = R.overlaps(queries, docs, 5)
    assert "w#" not in plan(out)
    want = {}
    for q, text in QUESTIONS.items():
        hits = [(-len(set(text.split()) & set(t.split())), d is None, d) for d, t in merged().items()]
        want[q] = [(d, -n) for n, _, d in sorted(h for h in hits if h[0])[:5]]
    got = {}
    for x in sorted(out.collect(), key=lambda x: (x.qid, x["rank"])):
        got.setdefault(x.qid, []).append((x.did, x.hits))
    assert got == {q: w for q, w in want.items() if w}


def test_statistics_shuffle_no_words_of_documents(spark):
    """a row for each document and word was shuffled."""
    docs = R.words_of(spark.createDataFrame(texts(), "id long, text string"), "id", "did")
    own = {i: t.split() for i, t in merged().items() if t.split()}
    df = Counter(w for ws in own.values() for w in set(ws))
    n = sum(map(len, own.values()))
    assert tuple(R.statistics(docs).first()) == (len(own), n, round(n / len(own), 6), len(df), max(df.values()))
    once = R.statistics(docs.filter("did >= 20 and did < 500"))
    assert not any("did" in line and "w#" in line for line in plan(once).splitlines() if "Exchange" in line)

import math
import random
from collections import Counter

import pytest

from lakeweave.operators import retrieval as R


def plain(queries, docs, how, k, mu=2000.0, lam=0.1):
    tf = {d: Counter(t.split()) for d, t in docs.items()}
    ctf = sum(tf.values(), Counter())
    total = sum(ctf.values())
    out = {}
    for q, text in queries.items():
        scores = []
        for d, c in tf.items():
            n = sum(c.values())
            if any(w in c for w in text.split()):
                prob = lambda w: (c[w] + mu * ctf[w] / total) / (n + mu) if how == "dirichlet" else (1 - lam) * c[w] / n + lam * ctf[w] / total  # noqa: B023, E731
                scores.append((round(sum(math.log(prob(w)) for w in text.split() if w in ctf), 6), d))
        out[q] = [d for _, d in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]
    return out


@pytest.mark.parametrize("how", ["dirichlet", "jelinek_mercer"])
def test_blocks_are_skipped_and_nothing_is_lost(spark, how):
    r = random.Random(3)
    docs = {i: " ".join(f"w{int(r.paretovariate(0.8))}" for _ in range(r.randint(1, 60))) for i in range(400)}
    docs |= {1000 + i: " ".join(r.choice(["red", "blue", "w1", "w2"]) for _ in range(20)) for i in range(40)}
    queries = {1: "red w1", 2: "blue blue w2 w1", 3: "w3 w7 w1", 4: "nowhere", 5: "w1"}
    post = lambda x, key: R.postings(spark.createDataFrame(list(x.items()), f"{key} long, text string"), key, "text", " ")
    out, reads = R.skipping(post(queries, "qid"), post(docs, "did"), how, 4, size=8, first=2)
    got = {}
    for x in sorted(out.collect(), key=lambda x: (x.qid, x["rank"])):
        got.setdefault(x.qid, []).append(x.did)
    assert got == {q: d for q, d in plain(queries, docs, how, 4).items() if d}
    read = {x.qid: (x.read, x.postings) for x in reads.collect()}
    assert all(a <= b for a, b in read.values()) and read[1][0] < 0.7 * read[1][1]
    one, _ = R.skipping(post(queries, "qid"), post(docs, "did"), how, 4, size=1, first=1)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, out.collect()))

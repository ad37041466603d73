import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lakeweave.llm import licenses, lm_score, mixing, near_dedup, toxicity

from . import odd


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_near(rows):
    """rows: (id, text). Sizes, component ids by all pairs."""
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = {}
    for own in groups.values():
        least = min((rows[i][0] for i in own if rows[i][0] is not None), default=None)
        for i in own:
            out[i] = (rows[i][0], len(sets[i]), least, rows[i][0] == least)
    return Counter(out.values())


@pytest.mark.parametrize("k,split,short", [(near_dedup.EXACT, 3, 0), (40, 2, 4)])
def test_near_dedup_equals_brute_force(spark, monkeypatch, k, split, short):
    monkeypatch.setattr(near_dedup, "SPLIT", split)
    monkeypatch.setattr(near_dedup, "SHORT", short)
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows, at = [], 0
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 8, 20, 50, 90, 200]))]
        for _ in range(r.randint(1, 9)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 18))):
                own[r.randrange(len(own))] = r.choice(vocab)
            rows.append((at, " ".join(own)))
            at += 1
    passage = " ".join(r.choice(vocab) for _ in range(50))
    rows += [(at + i, passage + " " + " ".join(r.choice(vocab) for _ in range(30))) for i in range(30)]
    r.shuffle(rows)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
    assert Counter(tuple(x) for x in got) == brute_near(rows)


def test_one_of_each_with_null_and_repeated_ids(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(None, text(0)), (None, text(1)), (3, text(2)), (3, text(3)), (4, text(3) + " more"), (None, text(3)), (None, None), (9, None), (9, "")]
    got = near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(x) for x in got) == Counter([*rows[:4], *rows[6:]])
    assert near_dedup.one_of_each(odd.empty(spark)).count() == 0


def test_near_dedup_of_odd_rows(spark):
    got = near_dedup.near_dedup(odd.documents(spark)).collect()
    assert Counter(tuple(x) for x in got) == brute_near([x[:2] for x in odd.rows()])
    assert near_dedup.near_dedup(odd.empty(spark)).count() == 0


def brute_base(rows):
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*words(lower(t)), None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        own = [*words(lower(t)), None]
        out.append((i, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in own)))
    return out


def test_near_dedup_hardly_misses_a_link(spark):
    k = near_dedup.K
    choose = lambda n, i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
    below = lambda n, s, x: sum(math.exp(choose(s, i) + choose(n - s, k - i) - choose(n, k)) for i in range(max(0, k - (n - s)), x))
    sizes = [(n, round(n * part)) for n in (200, 500, 2000, 20_000, 200_000) for part in (1, 0.95, 0.875, 0.8, 0.76)]
    rows = spark.createDataFrame(sizes, "n long, m long").select("n", "m", near_dedup.required(F.col("n"), F.col("m"), near_dedup.K).alias("q"), *[near_dedup.least_required(F.col(c), near_dedup.K).alias(f"q{c}") for c in "nm"])
    for x in rows.collect():
        shared = math.ceil((x.n + x.m) * 0.75 / 1.75)
        assert below(x.n, shared, x.q) + below(x.m, shared, x.q) < 1e-6
        assert max(x.qn, x.qm) <= x.q


@pytest.mark.parametrize("most", [10**6, 0])
def test_lm_base_equals_brute_force(spark, most):
    docs = odd.documents(spark).repartition(3)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    got = lm_score.score(docs, docs.filter(~held), max_words=most).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2], x[3], round(x[4], 6))
    mine = sorted(key((x.doc_id, x.n_tokens, x.n_known, x.train_tokens, x.base_score)) for x in got)
    assert mine == sorted(map(key, brute_base([x[:2] for x in odd.rows()])))
    assert all(x.score <= 0 for x in got)
    assert lm_score.score(odd.empty(spark), odd.empty(spark), max_words=most).count() == 0
    (one,) = lm_score.score(docs.filter("doc_id = 3"), odd.empty(spark), max_words=most).collect()
    assert one.train_tokens == 0 and one.n_known == 0 and one.base_score == 0


def test_lm_scores_are_near_a_plain_model(spark):
    """Counts by their levels' means in plain dictionaries; the filter may only answer too high, and seldom does."""
    import numpy as np

    r = random.Random(4)
    rows = [(i, " ".join(f"w{int(r.paretovariate(1))}" for _ in range(r.randint(0, 60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = Counter(), Counter()
    for _, t in rows[:200]:
        own = [None, *words(lower(t)), None]
        one.update(own[1:])
        two.update(zip(own, own[1:]))
    n, v = sum(one.values()), len(one)
    seen = lambda c: float(lm_score.MEANS[lm_score.level(np.array([c]))[0]]) if c else 0.0
    for bits, most in ((lm_score.BITS, 0.1), (4096, 1e-9)):  # in a large filter nothing stands that was not put there
        _near(lm_score.score(docs, docs.filter("doc_id < 200"), entry_bits=bits).collect(), rows, one, two, seen, n, v, most)


def _near(got, rows, one, two, seen, n, v, most):
    worse, total = 0.0, 0
    for x in got:
        own = [None, *words(lower(rows[x.doc_id][1])), None]
        p = [lm_score.WEIGHT * min(1.0, seen(two[a, b]) / max(seen(one[a]), 1.0)) + (1 - lm_score.WEIGHT) * min(1.0, (seen(one[b]) + 1) / (n + v + 1)) for a, b in zip(own, own[1:])]
        worse += abs(x.score - sum(map(math.log10, p)))
        total += len(p)
    assert worse < most * total


def test_lm_scores_do_not_depend_on_partitions(spark):
    docs = odd.documents(spark)
    one = lambda n: Counter((x.doc_id, x.n_tokens, round(x.score, 9)) for x in lm_score.score(docs.repartition(n), docs.repartition(n + 1).filter("doc_id % 3 = 0")).collect())
    assert one(3) == one(8) == one(40)


def test_lm_is_better_than_its_base_on_held_out_texts(spark):
    r = random.Random(2)
    follow = {i: [r.randrange(400) for _ in range(3)] for i in range(400)}

    def text():
        w = [r.randrange(400)]
        while len(w) < 80:
            w.append(r.choice(follow[w[-1]]))
        return " ".join(f"t{x}" for x in w)

    docs = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string")
    got = lm_score.score(docs.filter("doc_id >= 500"), docs.filter("doc_id < 500")).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.6 * got[1]


@pytest.mark.parametrize("most", [lm_score.MAX_WORDS, 3])
def test_lm_scores_do_not_depend_on_the_bound_of_a_part(spark, monkeypatch, most):
    docs = odd.documents(spark).repartition(3)
    one = lambda: Counter((x.doc_id, x.n_tokens, x.n_known, round(x.base_score, 9), round(x.score, 9)) for x in lm_score.score(docs, docs.filter("doc_id % 3 = 0"), max_words=most).collect())
    whole = one()
    monkeypatch.setattr(lm_score, "MAX_FILTER", 1 << 7)
    assert one() == whole


def test_counts_by_the_filter_are_near():
    import numpy as np

    for c in (1, 2, 3, 7, 100, 12345):
        q = int(lm_score.level(np.array([c]))[0])
        assert c / 1.6 <= lm_score.MEANS[q] <= c * 1.6


def test_exponent_meets_its_targets(spark):
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.06,), (0.04,)], "share double")
    a = mixing.exponent(shares, 0.9, 1e9)
    p = [x**a for x in (0.7, 0.2, 0.06, 0.04)]
    p = [x / sum(p) for x in p]
    assert abs(-sum(x * math.log(x) for x in p) - 0.9 * math.log(4)) < 1e-4
    a = mixing.exponent(shares, 1.0, 2.0)
    assert abs((0.7 / 0.04) ** (1 - a) - 2) < 1e-3
    assert mixing.exponent(shares, 0.1, 5.0) == 1.0
    assert mixing.exponent(shares.limit(1)) == 1.0


def brute_plan(rows, hashes, budget=None):
    """(id, epoch): block, by the definition; ``hashes`` has the random number of each (epoch, id)."""
    total = Counter()
    for _, source, n in rows:
        total[source] += n
    share = {s: n / sum(total.values()) for s, n in total.items()}
    low, high = min(share.values()), max(share.values())

    def entropy(a):
        p = [x**a for x in share.values()]
        return -sum(x / sum(p) * math.log(x / sum(p)) for x in p)

    def largest(ok):
        a, b = (1.0, 1.0) if ok(1.0) else (0.0, 1.0)
        for _ in range(mixing.STEPS // 2):
            m = (a + b) / 2
            a, b = (m, b) if ok(m) else (a, m)
        return a

    a = max(largest(lambda x: entropy(x) >= mixing.ENTROPY * math.log(len(share))), 1 - largest(lambda x: x * math.log(high / low) <= math.log(mixing.MAX_REPEAT)))
    z = sum(x**a for x in share.values())
    whole = budget or z * max(x ** (1 - a) for x in share.values()) * sum(total.values())
    blocks, out = max(1, round(whole / mixing.BLOCK_TOKENS)), {}
    for source, x in share.items():
        mine, read, epoch = x**a / z * whole, 0, 0
        while read < mine - 1e-6:
            for i, _, n in sorted((r for r in rows if r[1] == source), key=lambda r: hashes[epoch, r[0]]):  # noqa: B023
                if read < mine - 1e-6:
                    out[i, epoch] = math.floor(read / mine * blocks)
                read += n
            epoch += 1
    return out


@pytest.mark.parametrize("budget", [None, 9_000.0])
def test_mixing_equals_brute_force(spark, monkeypatch, budget):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 2_000)
    monkeypatch.setattr(mixing, "CELL", 7)
    rows = [(i, "big" if i % 10 else f"small{i % 3}", 5 + i * 7 % 50) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    each = docs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("epoch", "doc_id", F.xxhash64(F.lit(0), F.col("epoch"), F.col("doc_id")))
    hashes = {(x[0], x[1]): x[2] % (1 << 64) for x in each.collect()}
    signed = {k: h - (1 << 64) if h >> 63 else h for k, h in hashes.items()}
    cells = {k: h >> 11 for k, h in hashes.items()}  # cells are cut by the unsigned number, and ordered within by the signed one
    got = {(x.doc_id, x.epoch): x.block for x in mixing.plan(docs, ["doc_id"], "source", "n", budget=budget).collect()}
    of, sizes = {i: s for i, s, _ in rows}, Counter(s for _, s, _ in rows)
    order = {(e, i): (math.floor(cells[e, i] / (1 << 53) * math.ceil(sizes[of[i]] / 7)), signed[e, i]) for e, i in hashes}
    assert got == brute_plan(rows, order, budget)


def test_mixing_has_each_document_and_meets_the_weights(spark):
    rows = [(i, "big" if i % 10 else f"small{i % 3}", 5 + i * 7 % 50) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.plan(docs, ["doc_id"], "source", "n").toPandas()
    assert set(got.doc_id) == set(range(6000))
    assert got.groupby("doc_id").size().max() <= 3
    shares = got.groupby("source").n_tokens.sum() / got.n_tokens.sum()
    for source, want in got.groupby("source").weight.first().items():
        assert abs(shares[source] - want) < 0.01
    few = mixing.plan(docs, ["doc_id"], "source", "n", budget=20_000.0).toPandas()
    assert abs(few.n_tokens.sum() - 20_000) < 1_000
    assert not few.duplicated(["doc_id", "epoch"]).any()


def test_mixing_blocks_have_all_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 20_000)
    monkeypatch.setattr(mixing, "CELL", 100)
    docs = spark.createDataFrame([(i, "ab"[i % 4 == 0], 10 + i % 13) for i in range(9000)], "doc_id long, source string, n long")
    got = mixing.plan(docs, ["doc_id"], "source", "n").toPandas()
    assert got.block.nunique() > 5
    of = got.pivot_table(index="block", columns="source", values="n_tokens", aggfunc="sum")
    share = of["b"] / of.sum(axis=1)
    assert (abs(share - share.mean()) < 0.01).all()


def test_mixed_documents_keep_their_columns(spark):
    docs = odd.documents(spark)
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert {(x.doc_id, x.text) for x in rows} == {x[:2] for x in odd.rows()}
    assert len(rows) >= len(odd.rows())
    assert mixing.mix(odd.empty(spark)).count() == 0


def said(sentence, name="Foo Bar Inc."):
    return sentence.replace("{}", name).removesuffix(" ...")


def test_licences():
    own = licenses.Recogniser()
    full = "é\n" + " ".join(licenses.SENTENCES[k][0] for k in ("mit-grant", "mit-notice")) + " Noise here. " + licenses.SENTENCES["mit-warranty"][0] + "\nAll rights reserved."
    assert [x[0] for x in own.licences(full.encode())] == ["MIT", "all-rights-reserved"]
    assert own.licences(full.encode())[0][1] == 2
    assert full[slice(*own.licences(full.encode())[1][1:])] == "All rights reserved."
    assert [x[0] for x in own.licences(b"# RELEASED under  the MIT license.\nx\nLicensed under CC BY-NC 4.0. more")] == ["MIT", "CC-BY-NC-4.0"]
    assert own.licences(b"nothing is licensed here") == []


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// ", " " * 50])
@pytest.mark.parametrize("width", [40, 72, 10_000])
def test_licences_of_wrapped_texts(width, sign):
    own = licenses.Recogniser()
    wrapped = lambda *s: "\n".join(sign + x for y in s for x in textwrap.wrap(y, width, break_on_hyphens=False))
    for k, sentences in licenses.ALL_SENTENCES.items():
        for s in sentences:
            assert [x[0] for x in own.sentences(f"import os\n\n{wrapped(said(s))}\n\nx = 1".encode())] == [k], s
    other = "Some other words of no licence at all that are long enough to be wrapped at forty columns and more."
    for name, ids in licenses.RULES:
        one = [said(licenses.ALL_SENTENCES[k][0], "the University") for k in ids]
        for text in (wrapped(*one), wrapped(" ".join(one)), wrapped(f" {other} ".join(one))):
            assert [x[0] for x in own.licences(text.encode())] == [name]


BSD = """Copyright (c) 2010, {0}. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
{1}
THIS SOFTWARE IS PROVIDED BY {2} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
NOR = """   * Neither the name of {} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""


@pytest.mark.parametrize("text,names", [
    (BSD.format("Google Inc", NOR.format("Google Inc."), "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"), ["all-rights-reserved", "BSD-3-Clause"]),
    (BSD.format("The Regents", NOR.format("the University"), "THE REGENTS AND CONTRIBUTORS"), ["all-rights-reserved", "BSD-3-Clause"]),
    (BSD.format("Jo Doe", "", "JO DOE"), ["all-rights-reserved", "BSD-2-Clause"]),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0\nimport os", ["MIT", "Apache-2.0"]),
    ("/* SPDX-License-Identifier: GPL-2.0 */", ["GPL-2.0-only"]),
    ("// SPDX-License-Identifier: GPL-2.0+\n", ["GPL-2.0-or-later"]),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only WITH Classpath-exception-2.0"]),
    ("SPDX-License-Identifier: (MIT AND (LGPL-2.1+ OR BSD-3-Clause))", ["MIT", "LGPL-2.1-or-later", "BSD-3-Clause"]),
    ("SPDX-License-Identifier: LicenseRef-own\nMIT", []),
    ("Licensed under the Apache License 2.0.", ["Apache-2.0"]),
    ("This software is licensed under the MIT license (see LICENSE).", ["MIT"]),
    ("Blender Tools is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", ["GPL-3.0-or-later"]),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n", ["GPL-3.0-only"]),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", ["Apache-2.0"]),
    ('   Licensed under the Apache License, Version 2.0 (the "License");\n   you may not use this file except in compliance with the License.\n', ["Apache-2.0"]),
    ("The docs of this tool are licensed under the terms of the GNU General Public License, version 2, and of no other.", ["GPL-2.0-only"]),
    ("The film is available under the bridge. It is distributed under the counter. Free software is licensed to you. MIT and ISC are places.", []),
])
def test_licences_of_ordinary_texts(text, names):
    assert [x[0] for x in licenses.Recogniser().licences(text.encode())] == names


def test_licences_of_odd_rows(spark):
    got = licenses.license_spans(odd.documents(spark)).collect()
    assert len(got) == len(odd.rows()) and all(x.n_sentences == 0 for x in got)
    assert licenses.license_spans(odd.empty(spark)).count() == 0


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(9)
    clean = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(800)]
    bad = ["idiotic", "zumpfel", "vexquor", "wurmzig"]

    def text(n):
        w = [r.choice(clean) for _ in range(r.randint(20, 120))]
        for _ in range(n):
            w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "s", "ly"])
        return " ".join(w)

    rows = [(i, text(0 if i % 4 else 1 + i // 4 % 6), int(i % 4 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i < 800], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.severity(docs, labels).collect()}
    held = [x for x in rows if x[0] >= 800]
    assert sum(got[i].toxic == bool(t) for i, _, t in held) >= 0.97 * len(held)
    m = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    for i, t, _ in rows[::7]:  # plain sums over distinct words
        n = Counter(f for w in set(words(lower(t))) for f in toxicity.places(w.encode()))
        x = sum(math.log1p(c) * m.weight.get(f, 0.0) for f, c in n.items())
        p = [1 / (1 + math.exp(k - x)) for k in m.t]
        assert abs(got[i].severity - sum(p)) < 1e-9 and abs(got[i].p_toxic - p[0]) < 1e-9
        grade = [a - b for a, b in zip([1.0, *p], [*p, 0.0], strict=True)]
        assert grade[got[i].grade] > max(grade) - 1e-9 and got[i].toxic == (p[0] >= 0.5)
    few = [got[i].severity for i, _, t in held if t and 1 + i // 4 % 6 == 1]
    many = [got[i].severity for i, _, t in held if t and 1 + i // 4 % 6 == 6]
    assert sum(few) / len(few) < sum(many) / len(many)


def test_toxicity_features_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FLUSH", 50)
    docs = [(i, t) for i, t, *_ in odd.rows() if i is not None and i < 60]
    labels = {i: i % 2 for i in range(10, 40)}
    least = {i: min((t or "").encode() for j, t in docs if j == i) for i in labels}
    sets = {i: {f for w in toxicity.distinct_words(t) for f in toxicity.places(w)} for i, t in least.items()}
    bad, fine = (Counter(f for i, own in sets.items() if labels[i] == k for f in own) for k in (1, 0))
    n = {k: sum(v == k for v in labels.values()) for k in (0, 1)}
    part = lambda some, whole: math.log((some + 0.5) / (whole - some + 0.5))
    odds = {f: part(bad[f], n[1]) - part(fine[f], n[0]) for f in {*bad, *fine} if bad[f] + fine[f] >= 2}
    m = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels.items()], "doc_id long, toxic int"), "doc_id", "text", "toxic")
    assert set(m.weight) == {f for f, x in odds.items() if abs(x) >= toxicity.ODDS}
    assert list(m.t) == sorted(m.t) and len(m.t) <= toxicity.GRADES


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 40)], "doc_id long, toxic int")
    assert toxicity.severity(odd.documents(spark), labels).count() == len(odd.rows())
    assert toxicity.severity(odd.empty(spark), labels).count() == 0
    none = toxicity.severity(odd.documents(spark), labels.limit(0)).collect()
    assert not any(x.toxic or x.severity for x in none)

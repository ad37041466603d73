"""Labels and entities are scored by kinds of tables: no query meets every table."""

import math
import random
from collections import Counter

from lakeweave.operators import ranking as R

random.seed(5)
TABS = range(60)
LABELS = {t: set(random.sample("abcd", random.randint(0, 3))) for t in TABS}
ENTITIES = {t: set(random.sample(range(9), random.randint(0, 4))) for t in TABS}
LL = {t: random.choice([-1.5, -0.5, -30.0]) for t in TABS if t % 7}
WORDS = {t: Counter(random.choices(["x", "y", "z"], k=random.randint(1, 4))) for t in TABS if t % 5}
OWN, SEEDS = {1: {"a", "b"}, 2: {"c", "nowhere"}, 3: {"nowhere"}}, {1: {0, 1}, 2: {2}, 3: {3}}


def long(spark, d, schema, twice=1):
    return spark.createDataFrame([(k, x) for k, xs in d.items() for x in xs] * twice, schema)


def sides(spark):
    return long(spark, LABELS, "tab long, label string", 2), long(spark, ENTITIES, "tab long, entity long", 2), long(spark, OWN, "q long, label string"), long(spark, SEEDS, "q long, entity long")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_scores(spark):
    """a row for each query and table that shared a label."""
    labels, entities, own, seeds = sides(spark)
    out = R.label_scores(labels, entities, own, seeds, spark.createDataFrame(list(LL.items()), "tab long, ll double"))
    assert "tab#" not in plan(out)
    want = Counter()
    for q in OWN:
        for t in TABS:
            a, b = len(LABELS[t] & OWN[q]) / len(OWN[q]), len(ENTITIES[t] & SEEDS[q]) / len(SEEDS[q])
            for x in LABELS[t] if a or b else ():
                want[q, x] += max(a, 1e-6) * max(b, 1e-6) * max(math.exp(LL[t]) if t in LL else 0, 1e-6) / len(LABELS[t])
    got = {(x.q, x.label): x.score for x in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)


def test_entity_scores(spark):
    """pairs of tables and entities met each word and each label of the table, over and over."""
    labels, entities, own, seeds = sides(spark)
    captions = spark.createDataFrame([(t, w, n) for t, c in WORDS.items() for w, n in c.items()], "tab long, word string, tf long")
    asked = spark.createDataFrame([(q, w) for q in OWN for w in ("x", "z")], "q long, word string")
    out = R.entity_scores(entities, labels, captions, seeds, own, asked)
    assert "tab#" not in plan(out)
    ctf, all_labels, want = sum(WORDS.values(), Counter()), Counter(x for s in LABELS.values() for x in s), {}
    for q, s in SEEDS.items():
        full = [t for t in TABS if s <= ENTITIES[t]]
        for e in {e for t in full for e in ENTITIES[t]} - s:
            of = [t for t in TABS if e in ENTITIES[t]]
            tf, le = sum((WORDS.get(t, Counter()) for t in of), Counter()), Counter(x for t in of for x in LABELS[t])
            caption = math.prod((tf[w] + 2000 * ctf[w] / ctf.total()) / (tf.total() + 2000) for w in ("x", "z"))
            label = sum(0.5 * (le[x] + 2000 * all_labels[x] / all_labels.total()) / (le.total() + 2000) + 0.5 / len(OWN[q]) * le[x] / len(of) for x in OWN[q])
            want[q, e] = (0.5 * sum(e in ENTITIES[t] for t in full) / len(full), caption, label)
    got = {(x.q, x.entity): (x.by_seeds, x.by_caption, x.by_label) for x in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(x, y, rel_tol=1e-9) for k in got for x, y in zip(got[k], want[k], strict=True))

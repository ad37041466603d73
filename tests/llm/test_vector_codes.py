import math
import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, code string, _label string"


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract on Python integers: rows of (vec_id, integers, label), kept rows only and of one length."""
    width = len(rows[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, c: min((away(c[p], e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[near(p, c)[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(members[k]) for x in zip(*members[k], strict=True)) if k in members else e for k, e in enumerate(books[p])]
    found = [[near(p, c) for p in range(parts)] for c in cut]
    error, by_label = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for e, (_, _, label) in zip(error, rows, strict=True):
        by_label[label] += e
    out = sorted((r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]]) for r, f, e in zip(rows, found, error, strict=True))
    return out, sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def rows(n=150, dims=16, seed=1):
    r = random.Random(seed)
    out = [(i * 3, [r.gauss(0, 0.3) for _ in range(dims)], r.choice([None, 1, 2])) for i in range(n)]
    out += [(10_000 + i, list(out[0][1]), 1) for i in range(n // 2)]  # a third of all rows are copies
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, v, label, *["odd"] * 4) for i, v, label in data], SCHEMA)


def result(df):
    codes, books = vc.compress(df)
    got = sorted((x.id, x.code, x.error, x.label_error) for x in vc.label_errors(codes).collect())
    return got, sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def ints(data):
    return [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in data]


@pytest.mark.parametrize("parts", [1, 7])
def test_codes_equal_the_plain_version(spark, parts):
    data, bad = rows(), [(-1, None, 1), (-2, [], 1), (-3, [0.1] * 15 + [None], 1), (-4, [0.1] * 15 + [math.nan], 2), (-5, [math.inf] + [0.0] * 15, 2), (7000, [1.0] * 5, 1)]
    assert result(frame(spark, data + bad).repartition(parts)) == plain(ints(data))


def test_few_rows_repeated_ids_and_an_empty_table(spark):
    data = [(5, [float(i == j) for i in range(8)], None) for j in range(4)] + [(5, [0.0] * 8, None)] * 2
    assert result(frame(spark, data)) == plain(ints(data))
    got, _ = result(frame(spark, []))
    assert got == []
    assert vc.op11_vector_codes.__name__ == "op11_vector_codes"


def test_lengths_that_do_not_divide_and_huge_components(spark):
    data = [(i, [(-1.0) ** i * 3e38 if j == i % 10 else j / 7 for j in range(10)], 1) for i in range(30)]
    codes, books = vc.compress(frame(spark, data))
    assert books.shape == (8, 16, 2) and abs(books).max() <= vc.bound(10)
    assert codes.count() == 30 and codes.filter("error < 0").count() == 0


def test_sums_of_a_label_do_not_overflow(spark):
    codes = spark.range(4).select("id", F.lit(None).cast("int").alias("label"), F.lit("00").alias("code"), F.lit(vc.LONG_MAX - 1).alias("error"))
    assert {x.label_error for x in vc.label_errors(codes).collect()} == {vc.LONG_MAX}

"""Each stage, on its own input, against a brute-force version."""

from collections import Counter
from hashlib import sha256

import pytest

from lakeweave.llm import bpe, quality

from . import odd
from .test_line_dedup import brute as brute_lines, without
from .test_models_and_mixing import brute_near
from .test_tokens_and_scans import brute_quality

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


def table(spark, path):
    rows = [x for x in odd.rows() if x[1] is None or len(x[1]) < 60_000]
    docs = spark.createDataFrame(rows, odd.SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i > 12), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline as c

    docs, sf = table(spark, tmp_path), str(tmp_path)
    columns = docs.columns
    after = [docs]
    for name, f in c.STAGES:
        f(spark, after[-1], sf).write.parquet(f"{tmp_path}/out-{len(after)}")
        after.append(spark.read.parquet(f"{tmp_path}/out-{len(after)}"))
        assert name == "bpe" or after[-1].columns == columns
    rows = [[(x.doc_id, x.text) for x in d.select("doc_id", "text").collect()] for d in after[:5]]
    passed = [(i, t) for i, t in rows[0] if (n := brute_quality(t or ""))[0] >= 20 and 100 * n[4] <= 30 * n[0]]
    assert Counter(rows[1]) == Counter(passed)  # nothing here is far from the trusted documents
    assert Counter(rows[2]) == Counter(without(rows[1], brute_lines(rows[1])))
    kept = {i for (i, _, _, kept), _ in brute_near(rows[2]).items() if kept}
    assert {i for i, _ in rows[3]} == kept and set(rows[3]) <= set(rows[2])
    assert set(rows[4]) == set(rows[3])
    copies = Counter(i for i, _ in rows[4])
    assert 1 <= min(copies.values()) and max(copies.values()) <= 3
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, len(ids := lib.encode_ordinary(t or "")), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()) for i, t in rows[4])
    assert Counter(tuple(x) for x in after[5].collect()) == want


def test_run_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    table(spark, tmp_path)
    assert c.run(spark, str(tmp_path)).count() > 0
    empty = tmp_path / "empty"
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert c.run(spark, str(empty)).count() == 0


def test_accepted_equals_quality(spark):
    docs = odd.documents(spark).filter("length(text) < 60000")
    trusted = spark.createDataFrame([(i,) for i in range(20, 40)], "doc_id long")
    want = Counter(x.doc_id for x in quality.quality(docs, trusted).filter("kept").collect())
    got = quality.accepted(docs, trusted)
    assert got.columns == docs.columns
    assert Counter(x.doc_id for x in got.collect()) == want


def test_stages_take_very_long_texts_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as c

    odd.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i > 12), 0) for i in range(70)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, f) in enumerate(c.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out-{k}")
        docs = spark.read.parquet(f"{tmp_path}/out-{k}")
        if name == "bpe":
            continue
        assert docs.columns == columns
        rows = docs.collect()
        assert rows and all(x[c_] in ("odd", None) for x in rows for c_ in columns[5:])
        longest = max(len(x.text or "") for x in rows)
        assert before is None or longest == before  # nothing is cut, and the long text goes on to the end
        before = longest
    assert before > 60_000 and docs.count() == len(rows)

import math
import random
import re
import time
from collections import Counter
from hashlib import sha256

import pytest

from lakeweave.llm import automaton, bloom, bpe, exact_dedup, quality, secrets

from . import odd

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
RANKS = P.path("byte_bpe_50k.tiktoken")


def test_merges_equal_the_library():
    ranks = bpe.read_ranks(RANKS)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Codec(ranks, P.PATTERN)
    r = random.Random(1)
    texts = [x[1] or "" for x in odd.rows()] + ["".join(chr(r.choice([97, 98, 99, 32, 10, 233, 0x4E2D, 0x1F600, 39, 115])) for _ in range(r.randint(0, 60))) for _ in range(300)]
    for t in [*texts, "a" * 999, "<|endoftext|> don't we'll"]:
        ids = lib.encode_ordinary(t)
        assert own.encode(t) == ids
        assert own.decode(ids) == t.encode()
        assert own.digest(t) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(t.encode()).hexdigest())


def test_bpe_digest_of_odd_rows(spark):
    got = bpe.bpe_digest(odd.documents(spark), RANKS, P.PATTERN).collect()
    assert len(got) == len(odd.rows())
    assert {x.n_tokens for x in got if x.doc_id in (0, 1)} == {0}
    assert bpe.bpe_digest(odd.empty(spark), RANKS, P.PATTERN).count() == 0


def brute_secrets(text):
    out = []
    for k, (kind, pattern, ok) in enumerate([
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text, re.A) if ok(m)]
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


OTHERS = {
    "hub": (r"gh[opsru]_[A-Za-z0-9]+", 40), "chat": (r"xox[abprs]-[A-Za-z0-9-]+", 20), "maps": (r"AIza[A-Za-z0-9_-]+", 39),
    "web": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40), "pem": (r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY-----", 0),
}


def secret_texts():
    r = random.Random(3)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "\"", "'", " ", ":", "=", "AKIA", "abcdef0123456789", "ABCDEF0123", "deadbeef", "\n", "é", "🙂", "xyz", "A1b2C3d4E5f6", "gh", "ghp_", ".", "-", "eyJ", "xoxb-", "-----BEGIN RSA PRIVATE KEY-----", "AIza", "a" * 40]
    return [""] + ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(3000)] + ["token = api_key = " + "Q" * 20, "x" * 300 + "password:" + "z9" * 400 + " " + "0" * 70000]


def test_secrets_equal_brute_force():
    texts = secret_texts()
    for text, spans in zip(texts, secrets.Scanner().batch([t.encode() for t in texts]), strict=True):
        got = [(secrets.KINDS[k], s, e) for s, k, e in spans]
        assert [x for x in got if x[0] in secrets.BASE] == brute_secrets(text), text
        for kind, (pattern, least) in OTHERS.items():
            assert [x[1:] for x in got if x[0] == kind] == [m.span() for m in re.finditer(pattern, text) if len(m[0]) >= least], text
    assert {k for t in secret_texts() for k, (p, n) in OTHERS.items() if any(len(m[0]) >= n for m in re.finditer(p, t))} == set(OTHERS)


def test_secrets_of_a_long_line_take_linear_time():
    for text in (b"eyJ" * 400_000 + b".a.", b"token=" * 200_000, b"gh" * 600_000, b"-----BEGIN " * 100_000, b"0123456789abcdef" * 70_000):
        began = time.perf_counter()
        secrets.scanner().batch([text])
        assert time.perf_counter() - began < 10


def test_automaton_is_minimal():
    a = automaton.Machine([("(ab|cb)*", False)])
    assert len(a.accepts) == 3  # between pairs, inside a pair, dead


def test_secrets_of_odd_rows(spark):
    got = {x.doc_id: x.spans for x in secrets.secret_spans(odd.documents(spark)).collect()}
    for i, text, *_ in odd.rows():
        assert [tuple(s) for s in got[i] if s.kind in secrets.BASE] == brute_secrets(text or "")
    assert secrets.secret_spans(odd.empty(spark)).count() == 0


def test_exact_dedup_of_odd_rows(spark):
    for bits in (exact_dedup.MAX_BITS, bloom.BLOCK_BITS):
        got = exact_dedup.exact_dedup(odd.documents(spark), max_bits=bits).collect()
        rows = odd.rows()
        assert len(got) == len(rows)
        groups = {}
        for i, t, *_ in rows:
            groups.setdefault(t or "", []).append(i)
        for x in got:
            (own,) = [g for t, g in groups.items() if sha256(t.encode()).hexdigest() == x.text_sha256]
            assert x.group_size == len(own)
            assert x.keep_id == max((i for i in own if i is not None), default=None)
        assert sum(x.kept for x in got) == len(groups)
    assert exact_dedup.exact_dedup(odd.empty(spark)).count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins, hit = [tuple(words[i : i + 8]) for i in range(len(words) - 7)], set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            hit |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_of_odd_rows(spark):
    docs = odd.documents(spark).filter("doc_id is null or length(text) < 60000 or text is null")
    trusted = spark.createDataFrame([(i,) for i in range(20, 40)], "doc_id long")
    got = {x.doc_id: x for x in quality.quality(docs, trusted).collect()}
    for i, text, *_ in odd.rows():
        if i in got and len(text or "") < 60000:
            x = got[i]
            n = brute_quality(text or "")
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == n
            assert x.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
            assert not (x.kept and x.base_failed)
    assert quality.quality(odd.empty(spark), trusted).count() == 0
    assert quality.quality(docs, trusted.limit(0)).filter("kept = base_failed").count() == 0


def test_quality_verdict_equals_brute_force(spark):
    r = random.Random(8)
    good, junk = [f"g{i}" for i in range(80)], [f"j{i}" for i in range(80)]
    rows = [(i, " ".join(r.choice(junk if i % 5 == 0 else good).title() for _ in range(r.randint(15, 90)))) for i in range(200)]
    trusted = {i for i in range(0, 120) if i % 5}
    hashes = quality.WordHashes()
    grams = {i: quality.buckets(t.encode().split(), hashes).tolist() for i, t in rows}
    for i, t in rows[:5]:  # a bucket for each word and for each pair of neighbours, in lower case
        w = t.lower().split()
        assert len(grams[i]) == 2 * len(w) - 1
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for i in trusted for b in grams[i])
    total = lambda c: sum(c.values()) + quality.SMOOTHING * quality.BUCKETS
    ratio = lambda b: math.log((target[b] + quality.SMOOTHING) / total(target)) - math.log((raw[b] + quality.SMOOTHING) / total(raw))
    score = {i: sum(map(ratio, g)) / (len(g) + quality.SHRINK) for i, g in grams.items()}
    failed = {i: (n := brute_quality(t))[0] < 20 or 100 * n[4] > 30 * n[0] for i, t in rows}
    own = [score[i] for i in trusted if not failed[i]]
    mean = sum(own) / len(own)
    least = mean - quality.STEPS * (sum((x - mean) ** 2 for x in own) / len(own)) ** 0.5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.quality(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()
    assert any(not x.kept and not x.base_failed for x in got)
    for x in got:
        assert abs(x.score - score[x.doc_id]) < 1e-9
        assert x.kept == (not failed[x.doc_id] and score[x.doc_id] >= least)

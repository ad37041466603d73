import random
import re
from hashlib import sha256

from pyspark.sql import functions as F

from lakeweave.llm import fill_middle as fm

from . import odd

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain(doc_id, text):
    """The contract, token by token on Python strings."""
    t = TOKEN.findall(text)
    h = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(t), "plain", None, None, text
    x, y, z = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    return (len(t), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < 20 else (len(t), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}")


def texts():
    r = random.Random(4)
    parts = ["a", "Zz", "é", "🙂", " ", "\n", "<", "<P", "<S", ">", "P>", "[", "`", "{", "@", "0", "\u0000", "word"]
    return ["", "<P>", "x<M>y", "<", "\n\n"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(600)]


def test_cut_equals_the_plain_version():
    forms = set()
    for i, t in enumerate(texts()):
        n, form, a, b, out = fm.cut(i, t.encode())
        assert (n, form, a, b, out.decode()) == plain(i, t)
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_bytes_that_are_no_text_come_back():
    broken = b"ab \xff\xfe c\xe2\x82"
    for i in range(40):
        n, form, a, b, out = fm.cut(i, broken)
        assert n == 8 and out.replace(b"<P>", b"").replace(b"<S>", b"").replace(b"<M>", b"").count(b"\xff") == 1
        if form == "plain":
            assert out == broken


def test_broken_bytes_are_restored(spark):
    rows = [(i, bytearray(b"ab \xff\xfe c\xe2\x82 \xf0\x9f<")) for i in range(60)]
    got = fm.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text binary")).select("form", fm.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert {bytes(x.back) for x in got} == {bytes(rows[0][1])} and {x.form for x in got} == {"plain", "psm", "spm"}


def test_odd_rows_and_round_trip(spark):
    docs = odd.documents(spark).unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts())], "doc_id long, text string"), allowMissingColumns=True)
    got = fm.fill_in_middle(docs).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((x.doc_id, *plain(x.doc_id, x.text or ""), x.text or "") for x in docs.collect()), key=repr)
    assert sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, bytes(x.output).decode(), bytes(x.back).decode()) for x in got), key=repr) == want
    assert fm.fill_in_middle(odd.empty(spark)).count() == 0


def test_shares_are_parameters(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    assert {x.form for x in fm.fill_in_middle(docs, changed=0).collect()} == {"plain"}
    assert {x.form for x in fm.fill_in_middle(docs, changed=100, spm=100).collect()} == {"spm"}

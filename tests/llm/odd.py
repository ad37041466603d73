"""Small tables of odd documents."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _text string, _of string, _drop string, _digest string, _block string, _n string, block string"


def rows():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé ñß0189") for _ in range(r.randint(1, 6))).strip() or "x"
    texts = [None, "", " \n\t ", "one", "one two three four", "a b c d e", "A B C D E", "x" * 5000, "the same line here again\n" * 40, "🙂🙂 naïve\x0bcafé z w"]
    texts += [" ".join(word() for _ in range(r.randint(1, 120))) for _ in range(40)]
    texts += texts[12:20] + [t + " more" for t in texts[20:30]]
    texts.append(" ".join(word() for _ in range(30_000)))
    out = [(i, t, "en", "a" if i % 3 else None, len(t or ""), *["odd"] * 8) for i, t in enumerate(texts)]
    return out + [out[15], out[0], (None, "null id", *[None] * 11)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

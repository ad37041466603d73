"""Line dedup by a deletion-neighbourhood join, in DataFrame functions alone.

Lines are compared as sequences of words (lower case), with an edit bound of one word: one word put in, left out or
replaced. Of lines within the bound the earliest, by document id and line number, stays: a line goes if an equal line, or
one within the bound, comes before it. The bound is one word in NEAR: lines of under NEAR words go only as copies, for there
one word is too large a part. ``least`` is the number of words from which a line is compared at all; by default every line
that has a word is.

Equal lines are first put together by a 128-bit hash. A distinct line then emits the hash of itself and of each variant with
one word left out. Variants without word i that are equal come from lines that differ in word i alone; a variant that
equals a whole line comes from a line with one word more. Each such group has one line that stands for it (its earliest
line, or the whole line), so that links are as many as the group's lines, not its pairs. The edit distance of each link is
then verified on the words.

A line of over 2 * EDGE words within the bound of another shares its first or its last EDGE words with it, for one edit
touches one of them at most; so long lines emit variants only if another distinct line has that beginning or end. The
variants' hashes are XORs of hashes of (word, place), so that all of a line's variants cost one pass over its words.

Only lines that emit variants are read again. A Bloom filter of bounded size picks them in the second scan, and an exact
join follows; where the filter is full more lines reach the join and the result is the same.

Defined cases: a null text has no lines and stays null; lines without words stay; null ids come first; where ids are null or
repeated, rows are told apart, and equal ids ordered, by numbers of their own; of equal rows the later ones lose their lines as
copies; lines and texts of any length are compared whole; an empty table gives an empty result; all columns are passed on,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, repeated_ids, scratch, small, stash, unused
from .bloom import contained, filter_of

LEAST, NEAR, EDGE, BLOCK, LONG = 1, 8, 8, 128, 512
OTHER_SPACE = r"[\x09\x0B-\x0D]"


def words_of(line: Column) -> Column:
    """Lower-case words between ASCII white space. Splitting at one plain character is the fast way."""
    plain = F.when(line.rlike(OTHER_SPACE), F.regexp_replace(line, OTHER_SPACE, " ")).otherwise(line)
    return F.array_remove(F.split(F.lower(plain), " "), "")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _line, line) of all lines, in order from 0."""
    return docs.select(F.col(id_col).alias("_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("_line", "line"))


def _running(a: Column) -> Column:
    """Exclusive running XORs of an array, and the XOR of all at its end; in blocks, so that copies stay short."""
    xor = lambda x, y: x.bitwiseXOR(y)
    zero = F.lit(0).cast("long")
    scan = lambda c, base: F.aggregate(
        c, F.struct(base.alias("x"), F.array().cast("array<bigint>").alias("out")), lambda s, v: F.struct(xor(s["x"], v).alias("x"), F.array_append(s["out"], s["x"]).alias("out")), lambda s: s["out"]
    )
    starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))
    bases = scan(F.transform(blocks, lambda c: F.aggregate(c, zero, xor)), zero)
    return F.concat(F.flatten(F.transform(blocks, lambda c, b: scan(c, F.get(bases, b)))), F.array(F.aggregate(a, zero, xor)))


def variants(lines: DataFrame) -> DataFrame:
    """(key, at, o): for each line (o, n, text) of n words the hash of the line without word ``at``, and of the whole line with ``at`` -1."""
    cut = lambda part: lines.filter(part).select("o", F.split("text", " ").alias("w"), "n")
    without = lambda i: F.when(i < 0, F.xxhash64("w")).otherwise(F.xxhash64(F.slice("w", F.lit(1), F.greatest(i, F.lit(0))), F.slice("w", i + 2, F.col("n"))))
    emit = lambda df, key: df.select("o", F.explode(F.sequence(F.lit(-1), F.col("n") - 1)).alias("at"), *df.columns[1:]).select(key(F.col("at")).alias("key"), "at", "o")
    short = emit(cut(F.col("n") <= LONG + 1), without)
    long_ = cut(F.col("n") >= LONG).select("o", "n", F.transform("w", lambda x, j: F.xxhash64(x, j)).alias("here"), F.transform("w", lambda x, j: F.xxhash64(x, j - 1)).alias("moved"))
    long_ = long_.select("o", "n", _running(F.col("here")).alias("p"), _running(F.col("moved")).alias("q"))
    key = lambda i: F.when(i < 0, F.get("p", F.col("n"))).otherwise(F.get("p", i).bitwiseXOR(F.get("q", F.col("n"))).bitwiseXOR(F.get("q", i + 1)))
    keys = F.transform(F.sequence(F.lit(-1), F.col("n") - 1), lambda i: F.struct(key(i).alias("key"), i.alias("at")))
    return short.unionByName(long_.select("o", F.explode(keys).alias("x")).select("x.key", "x.at", "o"))


def verified(links: DataFrame, lines: DataFrame) -> DataFrame:
    """Of the links (late, early, at, kind), those whose words are within one edit: word ``at`` of the longer line, or of both."""
    side = lambda k, name: lines.select(F.col("o").alias(k), F.split("text", " ").alias(name))
    without = lambda c: F.concat(F.slice(c, F.lit(1), F.col("at")), F.slice(c, F.col("at") + 2, F.size(c)))
    both = links.join(side("late", "a"), "late").join(side("early", "b"), "early")
    cut = lambda c, other: F.when((F.size(c) > F.size(other)) | (F.size(c) == F.size(other)), without(F.col(c))).otherwise(F.col(c))
    return both.filter((F.abs(F.size("a") - F.size("b")) <= 1) & (cut("a", "b") == cut("b", "a"))).select("late", "early")


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and a column that has another value in each row: the id, or one more column that begins with it."""
    if not repeated_ids(docs, id_col):
        return docs, id_col
    (key,) = unused(docs, "_key")
    return stash(docs.withColumn(key, F.struct(F.col(id_col).alias("i"), F.monotonically_increasing_id().alias("n")))), key


def decided(docs: DataFrame, key: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(_id, _line, near): the lines that go; ``near`` tells those that only an edit parts from an earlier line. ``key`` is as by ``keyed``."""
    with scratch() as keep:
        return keep(_decided(docs, key, text_col, least))


def _decided(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    w = words_of(F.col("line"))
    edge = lambda c, salt: F.when(F.size("w") >= 2 * EDGE, F.xxhash64(c, F.lit(salt)))
    own = lines_of(docs, id_col, text_col).withColumn("w", w)  # a filter on the words here would cut every line twice
    own = stash(own.select("_id", "_line", F.size("w").alias("n"), F.xxhash64("w").alias("k"), F.xxhash64("w", F.lit(1)).alias("k2"), edge(F.slice("w", 1, EDGE), 2).alias("head"), edge(F.slice("w", -EDGE, EDGE), 3).alias("tail"))).filter(f"n >= {least}")
    first = own.groupBy("k", "k2", "n", "head", "tail").agg(F.min(F.struct("_id", "_line")).alias("f")).select("f._id", "f._line", "n", "head", "tail")
    first = stash(first.orderBy("_id", "_line").withColumn("o", F.monotonically_increasing_id()))
    ends = first.filter(f"n >= {2 * EDGE}").select("o", "n", F.explode(F.array("head", "tail")).alias("h"))
    common = ends.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    long_ones = ends.filter(f"n > {2 * EDGE}").join(common, "h").select("o").distinct()
    chosen = stash(first.filter(F.col("n").between(NEAR, 2 * EDGE)).select("_id", "_line", "o").unionByName(first.join(long_ones, "o").select("_id", "_line", "o")))
    place = F.xxhash64("_id", "_line")
    again = contained(lines_of(docs, id_col, text_col).withColumn("_h", place), filter_of(chosen.select(place.alias("_h")), "_h"), "_h").drop("_h")
    chosen = chosen.select(F.col("_id").alias("id_"), F.col("_line").alias("line_"), "o")
    again = again.join(chosen, F.col("_id").eqNullSafe(F.col("id_")) & (F.col("_line") == F.col("line_"))).select("o", "line")
    lines = again.dropDuplicates(["o"]).select("o", words_of(F.col("line")).alias("w"))
    lines = stash(lines.select("o", F.size("w").alias("n"), F.array_join("w", " ").alias("text")))
    rows = stash(variants(lines))
    parts = rows.filter("at >= 0")
    group = parts.groupBy("key", "at").agg(F.min("o").alias("early"), F.count("*").alias("c")).filter("c > 1").select("key", "at", "early")
    replaced = parts.join(small(stash(group)), ["key", "at"]).filter("early < o").select(F.col("o").alias("late"), "early", "at")
    whole = rows.filter("at < 0").select("key", F.col("o").alias("whole"))
    left_out = parts.join(small(stash(whole)), "key").select(F.greatest("o", "whole").alias("late"), F.least("o", "whole").alias("early"), "at")
    links = replaced.unionByName(left_out).groupBy("late").agg(F.min(F.struct("early", "at")).alias("x")).select("late", "x.early", "x.at")
    near = stash(verified(links, lines).select(F.col("late").alias("o")))
    near = first.join(near, "o").select(F.col("_id").alias("id_"), F.col("_line").alias("line_"))
    same = F.col("_id").eqNullSafe(F.col("id_")) & (F.col("_line") == F.col("line_"))
    firsts = first.select(F.col("_id").alias("id_"), F.col("_line").alias("line_"))
    copies = own.select("_id", "_line").join(firsts, same, "left_anti").distinct().withColumn("near", F.lit(False))
    late = near.select(F.col("id_").alias("_id"), F.col("line_").alias("_line")).withColumn("near", F.lit(True))
    return stash(copies.unionByName(late))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` without the lines that go; all columns, and documents that lose all their lines, stay."""
    own, key = keyed(docs, id_col)
    of, drop = unused(own, "_of", "_drop")
    gone = decided(own, key, text_col, least).groupBy(F.col("_id").alias(of)).agg(F.collect_set("_line").alias(drop))
    rest = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda i: F.get(lines, i))
    kept = F.get(F.transform(F.array(F.split(F.col(text_col), "\n")), lambda lines: F.array_join(rest(lines), "\n")), F.lit(0))  # cut once
    out = own.join(gone, F.col(key).eqNullSafe(F.col(of)), "left")
    return out.withColumn(text_col, F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, those that go as copies and as near copies, and the numbers of all that go."""
    docs, key = keyed(documents(spark, sf_dir), "doc_id")
    gone = decided(docs, key).groupBy(F.col("_id").alias("of")).agg(
        F.count_if(~F.col("near")).alias("n_copies"), F.count_if("near").alias("n_near"), F.array_join(F.array_sort(F.collect_list("_line")), ",").alias("dropped")
    )
    lines = docs.select(F.col(key).alias("key"), "doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = lines.join(gone, F.col("key").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "n_lines", F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("dropped", F.lit("")).alias("dropped"))

"""MinHash near-dedup on bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct runs of SHINGLE words (ASCII lower case); with fewer words, of the whole
sequence. Documents with equal sets are one node. A node's sketch is the k smallest hashes of its set.

Candidates come from inverted lists of retained values. If sets of n and m hashes have similarity 0.75, they share
(n + m) * 0.75 / 1.75 hashes, and of the k smallest hashes of either one a hypergeometric number lies among these. Both
sketches retain the smaller of the two numbers. ``required`` is DEVIATIONS standard deviations less than the mean of the
larger set's number, which is the least; for sets that are retained whole it is exact. Two nodes
of that similarity share ``required`` values of their sketches, so they share one of the first (size - required + 1)
of each, in the order of how many nodes retain a value. Only these are listed, with their places, and a shared value at a
later place than the two sizes allow makes no pair. The texts of nodes in lists of two or more are read once more, and
their full sets are kept as a table until the end.

Lists are not turned into all their pairs. In each of STARS rounds CENTRES nodes of each list are compared with those others
that the links so far leave in other components; a pair goes on if its estimate, the share of the k smallest values of
both sketches that both retain, is ESTIMATE or more, and the full sets then decide. What a round misses the last pass
finds. There, the nodes of a list outside its largest component are compared with those of other components, each
pair in the first list that it shares, if their sketches share ``required`` values. The union-sketch estimate from the WIDE
smallest hashes filters these pairs, before they leave the join where the list has over SHORT nodes; it is exact where
the union has no more hashes, and else DEVIATIONS standard deviations are allowed for. Full sets decide here too.

Rows of a list of over SPLIT nodes are dealt to as many tasks as it has SPLIT nodes, in every join on lists.

By the sum of both numbers' hypergeometric tails, a link of exactly 0.75 is missed once in 5.9 million at the worst of the
sizes tried (two sets of 20,000; 200 to 200,000 hashes, ratios 0.75 to 1), and more alike sets less often. With ``k`` no
less than the largest set (``EXACT`` always is) the sketches are whole sets, every bound is exact and no link is missed;
lists and the rows that carry sketches are then as long as the documents.

Defined cases: a null text is the empty text; a document without words has an empty set and is linked with nothing; null
ids are left out when the smallest id is taken, and a component of null ids alone has a null id; rows with the same
text fall in one component, and kept holds for each row that has the component's id; texts of any length are read whole;
an empty table gives an empty result; columns but the id are not passed on, and any other column is left out whatever its name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WordHashes, by_key, documents, mix, repeated_ids, scratch, small, spread, stash, unused, windows

SHINGLE, K, PERCENT = 5, 128, 75
DEVIATIONS, ESTIMATE, STARS, CENTRES = 6, 0.58, 2, 2
WIDE, SHORT, SPLIT = 512, 64, 1_000
EXACT = (1 << 31) - 1


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The sorted set of a text: 63-bit hashes."""
    h = hashes.of((text or b"").lower().split())
    if 0 < len(h) < SHINGLE:
        own = mix(windows(h, len(h)) + np.uint64(len(h)))
    else:
        own = windows(h, SHINGLE)
    return np.unique(own >> np.uint64(1)).astype(np.int64)


def mark(own: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def features(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(x.as_py(), hashes) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([mark(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:k] for s in sets], pa.list_(pa.int64()))],
                names=list("abcd"),
            )

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col), F.col(text_col).cast("binary"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, _mark binary, n_shingles long, _sketch array<long>").withColumnRenamed(id_col, "_id").withColumn("_row", F.monotonically_increasing_id())


def required(n: Column, m: Column, k: int) -> Column:
    """How many values the sketches of sets of n and m hashes share at least, if the sets are similar enough."""
    large = F.greatest(n, m).cast("double")
    p = (n + m) * (PERCENT / (100 + PERCENT)) / large
    seen = F.least(large, F.lit(float(k)))
    return F.ceil(seen * p - DEVIATIONS * F.sqrt(seen * p * F.greatest(1 - p, F.lit(0.0)) * (1 - seen / large)) - 1e-6)


def least_required(n: Column, k: int) -> Column:
    """``required`` for the partner that asks for least: the sizes of partners lie between n * 0.75 and n / 0.75."""
    part = PERCENT / 100
    return F.ceil(part * F.least(n, F.lit(k)) - DEVIATIONS * F.sqrt(k * part * (1 - part) * F.greatest(F.lit(0.0), 1 - k * part / n)) - 1e-6)


def may_meet(n: Column, at: Column, m: Column, there: Column, k: int) -> Column:
    """Whether a value at place ``at`` of one sketch and ``there`` of the other can be the first that similar sets share."""
    left = lambda size, place: F.least(size, F.lit(k)) - place + 1
    near = F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT
    return near & (left(n, at) >= required(n, m, k)) & (left(m, there) >= required(n, m, k))


def ordered(nodes: DataFrame, k: int) -> DataFrame:
    """(node, n, alone, s): the values that other nodes retain too, rarest first, and the number of those that none does."""
    post = nodes.select("node", "n", F.explode("sketch").alias("v"))
    shared = post.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1")
    own = post.join(shared, "v").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("s"))  # k values at most
    return own.select("node", "n", (F.least("n", F.lit(k)) - F.size("s")).alias("alone"), F.transform("s", lambda x: x["v"]).alias("s"))


def listed(order: DataFrame, k: int) -> DataFrame:
    """(v, node, n, at): the values by which nodes are compared, and their places in the nodes' orders."""
    places = F.greatest(F.least("n", F.lit(k)) - least_required(F.col("n"), k) + 1 - F.col("alone"), F.lit(0)).cast("int")
    return order.select("node", "n", "alone", F.posexplode(F.slice("s", F.lit(1), places)).alias("i", "v")).select("v", "node", "n", (F.col("alone") + F.col("i") + 1).alias("at"))


def _parts(size: Column) -> Column:
    return F.ceil(size / SPLIT).cast("int")


def dealt(lists: DataFrame) -> DataFrame:
    """``lists`` of two nodes or more, with each list's length ``c`` and the ``part`` of it that a row belongs to."""
    sizes = stash(lists.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1"))
    long_ = small(stash(sizes.filter(F.col("c") > SPLIT).select("v", _parts(F.col("c")).alias("parts"))))
    rows = lists.join(long_, "v", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    return stash(rows.join(in_parts(sizes), ["v", "part"]))


def in_parts(by_list: DataFrame) -> DataFrame:
    """A table of one row a list, with the list's length ``c``: a copy for each part of the list."""
    return by_list.withColumn("part", F.explode(F.sequence(F.lit(0), _parts(F.col("c")) - 1)))


def alike(pairs: DataFrame, sketches: DataFrame, k: int, least: float) -> DataFrame:
    """Of the pairs (a, b), those whose sketches (node, sketch) say that they may be similar enough."""
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(estimated(F.col("sa"), F.col("sb"), k, least)).select("a", "b")


def estimated(a: Column, b: Column, k: int, least: float) -> Column:
    """Whether the share of the k smallest values of two sketches that both retain is ``least`` or more; 0.75 where they are whole sets."""
    least_of = lambda u: F.when(F.size(u) < k, F.lit(float(PERCENT))).otherwise(F.lit(100 * least)) * F.size(u)
    return _bound(F.slice(F.array_sort(F.array_union(a, b)), 1, k), lambda u: 100 * F.size(F.array_intersect(F.array_intersect(a, b), u)) >= least_of(u))


def _bound(value: Column, test: Callable[[Column], Column]) -> Column:
    """``test`` of ``value``, which is computed once and only where what stands before it in a conjunction holds.

    Spark computes an expression that stands twice in a condition ahead of the condition, for every pair of a join.
    """
    return F.exists(F.array(value), test)


def full_sets(listed_nodes: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, wide: int) -> DataFrame:
    """(node, set, sketch of the ``wide`` smallest) of the nodes in lists. Only their texts are read again."""
    used = stash(nodes.select("node", "_id", "_mark").join(listed_nodes, "node"))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t"))
    wanted = small(used.select(F.col("_id").alias("_of")).distinct())
    texts = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_of")), "left_semi")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(x.as_py(), hashes) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([mark(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s[:wide] for s in sets], pa.list_(pa.int64()))], names=list("abcd"))

    sets = texts.mapInArrow(again, f"_id {kind}, _mark binary, set binary, sketch array<long>").drop("_id")
    return stash(sets.join(small(used.select("node", "_mark")), "_mark").select("node", "set", "sketch").dropDuplicates(["node"]))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k: sets.select(F.col("node").alias(k), F.col("set").alias(f"s{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes in edges (a, b): comp is the component's smallest node. Labels halve their way, round by round."""
    both = stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")))
    while True:
        of = small(labels)
        seen = both.join(of.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = seen.join(of, "node").select("node", "comp", F.least("comp", "near").alias("new"))
        jump = of.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        now = stash(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("comp"), (F.col("comp") != F.least("new", F.coalesce("far", "new"))).alias("moved")))
        labels = now.select("node", "comp")
        if not now.filter("moved").limit(1).count():
            return labels


def star(lists: DataFrame, turn: int, k: int) -> DataFrame:
    """(a, b): CENTRES nodes of each list, by hashes of their own for each turn, with each other of another component that they may meet."""
    by_hash = [F.min_by(F.struct("node", "n", "at", "comp"), F.xxhash64("node", F.lit(turn * CENTRES + i))) for i in range(CENTRES)]
    centre = lists.groupBy("v").agg(F.array(*by_hash).alias("o"), F.max("c").alias("c")).withColumn("o", F.explode(F.array_distinct("o")))
    centre = in_parts(centre).select("v", "part", F.col("o.node").alias("a"), F.col("o.n").alias("m"), F.col("o.at").alias("there"), F.col("o.comp").alias("far"))
    met = (F.col("a") != F.col("node")) & (F.col("comp") != F.col("far")) & may_meet(F.col("n"), F.col("at"), F.col("m"), F.col("there"), k)
    return lists.join(centre, ["v", "part"]).filter(met).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels (node, comp) after edges (a, b) have joined components: only the edges between components are walked."""
    side = lambda k: small(labels).select(F.col("node").alias(k), F.col("comp").alias(f"c{k}"))
    between = edges.join(side("a"), "a").join(side("b"), "b").filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    moved = components(between.distinct()).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    return stash(labels.join(small(moved), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")))


def unsettled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """``lists`` with the components by ``labels`` and each list's largest one, ``main``, without the lists that lie in one component."""
    own = lists.drop("comp", "main").join(small(labels), "node")
    sizes = own.groupBy("v", "comp").agg(F.count("*").alias("of"), F.max("c").alias("c"))
    open_ = sizes.groupBy("v").agg(F.max_by("comp", F.struct("of", "comp")).alias("main"), F.count("*").alias("comps"), F.max("c").alias("c"))
    return stash(own.join(in_parts(open_.filter("comps > 1")).select("v", "part", "main"), ["v", "part"]))


def rest(lists: DataFrame, order: DataFrame, sets: DataFrame, k: int, wide: int, least: float) -> DataFrame:
    """(a, b): the pairs of nodes that share a list, lie in different components and may be similar, each once."""

    def compared(rows: DataFrame, by: list[str], test: Column) -> DataFrame:
        few = rows.filter("comp <> main")
        if "part" in by:
            few = in_parts(few.drop("part"))
        few = few.select(*[F.col(c).alias(f"{c}_") for c in few.columns])
        if "part" in by:  # dealt out already: nothing is left for the session to split by map outputs, on both sides
            few, rows = few.repartition(tasks, "v_", "part_"), rows.repartition(tasks, "v", "part")
        each = (F.col("comp") == F.col("main")) | (F.col("node_") < F.col("node"))
        met = (F.col("comp") != F.col("comp_")) & each & may_meet(F.col("n"), F.col("at"), F.col("n_"), F.col("at_"), k)
        met = met & _bound(F.array_intersect("s", "s_"), lambda x: (F.size(x) >= required(F.col("n"), F.col("n_"), k)) & (F.get(x, F.lit(0)) == F.col("v"))) & test
        on = [F.col(c) == F.col(f"{c}_") for c in by]
        return rows.join(few, [*on, met]).select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"))

    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lists.join(order.select("node", "s"), "node")
    short = stash(compared(rows.filter(F.col("c") <= SHORT), ["v"], F.lit(True)))
    long_ = rows.filter(F.col("c") > SHORT).join(sets.select("node", F.col("sketch").alias("w")), "node")
    long_ = compared(long_, ["v", "part"], estimated(F.col("w"), F.col("w_"), wide, least))
    return alike(short, sets.select("node", "sketch"), wide, least).unionByName(long_)


def labelled(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, comp) by all links, of the nodes that share a value with another one."""
    order = stash(ordered(nodes, k))
    labels = order.select("node", F.col("node").alias("comp"))
    lists = dealt(listed(order, k)).withColumn("comp", F.col("node"))
    wide = max(WIDE, k)
    sets = full_sets(small(stash(lists.select("node").distinct())), nodes, docs, id_col, text_col, wide)
    sketches = sets.select("node", F.slice("sketch", 1, k).alias("sketch"))
    for turn in range(STARS):
        found = confirmed(stash(alike(star(lists, turn, k), sketches, k, ESTIMATE)), sets)
        labels = joined(labels, stash(found))
        lists = unsettled(lists, labels)
    part = PERCENT / 100
    least = part - DEVIATIONS * (part * (1 - part) / wide) ** 0.5
    return joined(labels, stash(confirmed(stash(rest(lists, order, sets, k, wide, least)), sets)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    docs = spread(docs)
    rows = stash(features(docs, id_col, text_col, k))
    classes = rows.filter(F.col("_mark").isNotNull()).groupBy("_mark").agg(F.min("_row").alias("node"), F.min("_id").alias("_least"), F.count("*").alias("_copies"))
    classes = stash(classes)
    with scratch() as keep:
        nodes = stash(rows.join(small(classes.select(F.col("node").alias("_row"))), "_row").select(F.col("_row").alias("node"), "_id", "_mark", F.col("n_shingles").alias("n"), F.col("_sketch").alias("sketch")))
        comps = keep(labelled(nodes, docs, id_col, text_col, k))
    where = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = stash(where.groupBy("comp").agg(F.min("_least").alias("component_id"), F.count("*").alias("_classes")))
    where = stash(by_key(where, least, "comp", "_classes").select("_mark", "component_id", "_copies"))
    linked = by_key(rows.filter(F.col("_mark").isNotNull()), where, "_mark", "_copies").select("_id", "n_shingles", "component_id")
    alone = rows.filter(F.col("_mark").isNull()).select("_id", "n_shingles", F.col("_id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group: the one with the least id; null ids come after all others.

    Where ids are null or repeated, rows are told apart by numbers of their own, and of equal ids the least number stays.
    """
    of, own = unused(docs, "_of", "_own")
    if not repeated_ids(docs, id_col):
        kept = stash(near_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias(of)))
        return docs.join(kept, F.col(id_col) == F.col(of), "left_semi")
    numbered = stash(docs.withColumn(own, F.monotonically_increasing_id()))
    groups = near_dedup(numbered, own, text_col).select(F.col(own).alias(of), "component_id")
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(own))).alias(of)
    kept = numbered.select(id_col, own).join(groups, F.col(own) == F.col(of)).groupBy("component_id").agg(first).select(F.col(of)[own].alias(of))
    return numbered.join(stash(kept), F.col(own) == F.col(of), "left_semi").select(*docs.columns)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))

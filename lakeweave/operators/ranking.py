"""Candidates for the next label of a table, the next entity of a column, or the value of a cell, ranked by what tables share with seeds.

Every function takes many queries at once (column ``q``) and seeds as tables; probabilities have a floor, so that one missing factor
does not hide the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.sources.writers import checkpoint_dir

FLOOR, EXACT, UNKNOWN = 1e-6, 10_000.0, -1.0


def floored(c: Column | str) -> Column:
    return F.greatest(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)).cast("double"), F.lit(FLOOR))


def overlap(held: DataFrame, seeds: DataFrame, item: str, name: str, by: str = "tab") -> DataFrame:
    """(q, tab, share of the query's distinct seeds that the table holds); tables without any have no row. Rows of no seed are not shuffled."""
    seeds = seeds.select("q", item).distinct()
    size = seeds.groupBy("q").agg(F.count("*").alias("_n"))
    met = held.select(by, item).join(seeds, item).distinct().groupBy("q", by).agg(F.count("*").alias("_m"))
    return met.join(size, "q").select("q", by, (F.col("_m") / F.col("_n")).alias(name))


def label_sets(labels: DataFrame) -> DataFrame:
    """(tab, labels): each table's labels, once each and in order."""
    return labels.select("tab", "label").distinct().groupBy("tab").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def label_scores(labels: DataFrame, entities: DataFrame, seed_labels: DataFrame, seed_entities: DataFrame, likelihood: DataFrame) -> DataFrame:
    """(q, label, score): over the tables that share a label or an entity with the seeds, the product of both overlaps and of
    exp(``likelihood``), each with its floor, dealt equally to the table's labels.

    ``labels`` (tab, label), ``entities`` (tab, entity), seeds (q, label) and (q, entity), ``likelihood`` (tab, ll).

    No row is made for a query and a table that share labels alone: what such a table adds follows from its set of labels, so likelihoods are
    summed by sets (and by the seed entities that a table has, if any), and queries meet these sums.
    """
    checkpoint_dir(labels.sparkSession)
    hits = overlap(entities, seed_entities, "entity", "by_entity").groupBy("tab").agg(F.array_sort(F.collect_list(F.struct("q", floored("by_entity").alias("e")))).alias("hits"))
    x = label_sets(labels).join(likelihood.select("tab", F.exp("ll").alias("_l")), "tab", "left").join(hits, "tab", "left")
    sums = x.groupBy("labels", "hits").agg(F.sum(floored("_l")).alias("l")).checkpoint()
    whole = sums.groupBy("labels").agg(F.sum("l").alias("l"))
    near = overlap(whole.select("labels", F.explode("labels").alias("label")), seed_labels, "label", "by_label", "labels").withColumn("by_label", floored("by_label"))
    alone = near.join(whole, "labels").select("q", "labels", (F.col("by_label") * FLOOR * F.col("l")).alias("p"))
    met = sums.select("labels", "l", F.explode("hits").alias("h")).select("labels", "l", "h.q", "h.e").join(near, ["q", "labels"], "left")
    more = F.when(F.col("by_label").isNull(), FLOOR * F.col("e")).otherwise(F.col("by_label") * (F.col("e") - FLOOR))  # than without the entity
    p = alone.unionByName(met.select("q", "labels", (more * F.col("l")).alias("p"))).groupBy("q", "labels").agg(F.sum("p").alias("p"))
    each = p.select("q", F.explode("labels").alias("label"), (F.col("p") / F.size("labels")).alias("p"))
    return each.groupBy("q", "label").agg(F.sum("p").alias("score"))


def entity_scores(entities: DataFrame, labels: DataFrame, captions: DataFrame, seeds: DataFrame, asked_labels: DataFrame, asked_words: DataFrame, lam: float = 0.5, mu: float = 2000.0) -> DataFrame:
    """(q, entity, by_seeds, by_caption, by_label, score): the product of three probabilities with a floor.

    Of an entity that is in a table with all of the seeds: ``lam`` times the share of those tables that hold it; the likelihood of the asked
    words by the captions of its tables, smoothed by all captions; and for each asked label its smoothed and its plain share among the entity's
    tables. ``entities`` (tab, entity), ``labels`` (tab, label), ``captions`` (tab, word, tf), seeds (q, entity), asked (q, label) and (q, word).
    """
    checkpoint_dir(entities.sparkSession)
    rows = entities.select("tab", "entity")
    with_all = overlap(rows, seeds, "entity", "share").filter("share = 1").select("q", "tab").checkpoint()
    tables = with_all.groupBy("q").agg(F.count("*").alias("_n"))
    both = rows.join(with_all, "tab").distinct().groupBy("q", "entity").agg(F.count("*").alias("_m")).join(seeds.select("q", "entity").distinct(), ["q", "entity"], "left_anti")
    cand = both.join(tables, "q").select("q", "entity", (lam * F.col("_m") / F.col("_n")).alias("by_seeds")).checkpoint()

    # what tables say is held once a table, and counted by kinds of tables: words and labels are dealt out only then
    said = captions.groupBy("tab").agg(F.array_sort(F.collect_list(F.struct("word", "tf"))).alias("words"))
    about = said.join(label_sets(labels), "tab", "full").checkpoint()
    kinds = about.groupBy("words", "labels").agg(F.count("*").alias("n")).checkpoint()
    held = rows.join(cand.select("entity").distinct(), "entity", "left_semi").repartition("tab").dropDuplicates(["tab", "entity"])
    found = held.join(about, "tab", "left").groupBy("entity", "words", "labels").agg(F.count("*").alias("n")).checkpoint()
    words_of = lambda df, *by: df.select(*by, "n", F.explode("words").alias("x")).groupBy(*by, F.col("x.word").alias("word"))
    labels_of = lambda df, *by: df.select(*by, "n", F.explode("labels").alias("label")).groupBy(*by, "label")
    times = F.sum(F.col("x.tf") * F.col("n"))

    every = words_of(kinds).agg(times.alias("ctf"))
    whole = float(every.agg(F.sum("ctf")).first()[0] or 1)
    words = words_of(found, "entity").agg(times.alias("tf"))
    length = words.groupBy("entity").agg(F.sum("tf").alias("len"))
    asked = cand.select("q", "entity").join(asked_words.select("q", "word"), "q").join(every, "word", "left").join(words, ["entity", "word"], "left").join(length, "entity", "left").fillna(0, ["ctf", "tf", "len"])
    p = (F.col("tf") + mu * F.col("ctf") / whole) / (F.col("len") + mu)
    said = asked.groupBy("q", "entity").agg(F.exp(F.sum(F.when(p > 0, F.log(p)))).alias("by_caption"))

    all_labels = labels_of(kinds).agg(F.sum("n").alias("_all"))
    n_labels = all_labels.agg(F.sum("_all")).first()[0] or 1
    marked = labels_of(found, "entity").agg(F.sum("n").alias("_le"))
    per = found.groupBy("entity").agg(F.sum("n").alias("_e")).join(marked.groupBy("entity").agg(F.sum("_le").alias("_len")), "entity", "left")
    many = asked_labels.select("q", "label").distinct()
    many = many.join(many.groupBy("q").agg(F.count("*").alias("_k")), "q").join(all_labels, "label", "left")
    each = cand.select("q", "entity").join(many, "q").join(per, "entity").join(marked, ["entity", "label"], "left").fillna(0, ["_all", "_le", "_len"])
    smooth = (F.col("_le") + mu * F.col("_all") / n_labels) / (F.col("_len") + mu)
    named = each.groupBy("q", "entity").agg(F.sum(lam * smooth + (1 - lam) / F.col("_k") * F.col("_le") / F.col("_e")).alias("by_label"))

    out = cand.join(said, ["q", "entity"], "left").join(named, ["q", "entity"], "left")
    return out.withColumn("score", floored("by_seeds") * floored("by_caption") * floored("by_label"))


def header_scores(candidates: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(q, cand, score): the best of a candidate's headers for the asked one: EXACT where they are equal, else how near they
    are by ``near`` (header, other, sim: counts of shared values, or cosines of header vectors), else UNKNOWN.

    ``candidates`` is (q, asked, cand, header).
    """
    x = candidates.select("q", "asked", "cand", "header").distinct()
    x = x.withColumn("sim", F.lit(None).cast("double")) if near is None else x.join(near.select(F.col("header").alias("asked"), F.col("other").alias("header"), F.col("sim").cast("double").alias("sim")), ["asked", "header"], "left")
    one = F.when(F.col("asked") == F.col("header"), F.lit(EXACT)).otherwise(F.coalesce("sim", F.lit(UNKNOWN)))
    return x.groupBy("q", "cand").agg(F.max(one).alias("score"))

"""Metrics as aggregates over DataFrames, and a registry of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.operators import ranks


def ranked(results: DataFrame, truth: DataFrame, by: str = "qid", item: str = "cid") -> DataFrame:
    """Results (by, item, rank) with rel, hits so far and the size of the truth; queries without results get a row of nulls."""
    gt = truth.select(by, item).distinct().withColumn("rel", F.lit(1))
    n = gt.groupBy(by).agg(F.count("*").alias("n_gt"))
    r = results.select(by, item, "rank").join(gt, [by, item], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("hits", F.sum("rel").over(w)).withColumn("n_results", F.count("*").over(Window.partitionBy(by)))
    return n.join(r, by, "left")


def _per_query(r: DataFrame, k: int, by: str) -> DataFrame:
    top = F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("rel"))), F.lit(0))
    return r.groupBy(by).agg(top.alias("h"), F.max("n_gt").alias("g"), F.coalesce(F.max("n_results"), F.lit(0)).alias("n"))


def join_prf_at_k(r: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """Precision over min(k, number of results), recall over the truth, F1; means over queries."""
    q = _per_query(r, k, by)
    p = F.coalesce(F.try_divide(F.col("h"), F.least(F.lit(k), F.col("n"))), F.lit(0.0))
    rec = F.col("h") / F.col("g")
    f = F.coalesce(F.try_divide(2 * p * rec, p + rec), F.lit(0.0))
    m = lambda c: F.round(F.avg(c), 6)
    return q.agg(m(p).alias("precision"), m(rec).alias("recall"), m(f).alias("f1")).withColumn("k", F.lit(k))


def average_precision(r: DataFrame, by: str = "qid") -> DataFrame:
    """Sum of precisions at relevant ranks over the size of the truth, over the full list."""
    return r.groupBy(by).agg(F.round(F.coalesce(F.sum(F.col("hits") / F.col("rank") * F.col("rel")), F.lit(0.0)) / F.max("n_gt"), 6).alias("ap"))


def union_map(r: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """Precision over k for each 1 .. k, its mean over queries, and the mean of these so far (the union task's MAP)."""
    ks = r.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("k"))
    # a bounded list of cut-offs, not a join of tables
    hits = r.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k)))).groupBy(by, "k").agg(F.coalesce(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("rel"))), F.lit(0)).alias("h"))
    p = hits.groupBy("k").agg(F.avg(F.col("h") / F.col("k")).alias("p")).join(ks, "k")
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return p.select("k", F.round("p", 6).alias("precision"), F.round(F.avg("p").over(w), 6).alias("map"))


def micro_precision(r: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """Hits over k times the number of queries whose truth has k items or more."""
    q = _per_query(r, k, by).filter(F.col("g") >= k)
    return q.agg(F.round(F.try_divide(F.sum("h"), F.count("*") * k), 6).alias("precision"), F.count("*").alias("n_queries"))


def first_hit(r: DataFrame, ks: list[int], by: str = "qid") -> DataFrame:
    """Recall (any hit) at each k, MRR and binary NDCG of the first hit."""
    q = r.groupBy(by).agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("at"))
    return q.agg(
        *[F.round(F.avg(F.coalesce(F.col("at") <= k, F.lit(False)).cast("int")), 6).alias(f"recall_{k}") for k in ks],
        F.round(F.avg(F.coalesce(1 / F.col("at"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce(1 / F.log2(F.col("at") + 1), F.lit(0.0))), 6).alias("ndcg"),
    )


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """(class, tp, fp, fn) of each class in either column."""
    both = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    rows = both.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said"), F.lit(0).cast("long").alias("tp")))).alias("x"))
    return rows.groupBy(F.col("x.c").alias("class")).agg(F.sum("x.tp").alias("tp"), (F.sum("x.said") - F.sum("x.tp")).alias("fp"), (F.sum("x.true") - F.sum("x.tp")).alias("fn"))


def _f1() -> Column:
    return F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))


def f1_macro(df, y, p):
    return confusion(df, y, p).agg(F.round(F.avg(_f1()), 6).alias("f1"))


def f1_weighted(df, y, p):
    n = F.col("tp") + F.col("fn")
    return confusion(df, y, p).agg(F.round(F.sum(_f1() * n) / F.sum(n), 6).alias("f1"))


def f1_micro(df, y, p):
    return confusion(df, y, p).agg(F.round(2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn")), 6).alias("f1"))


def binary(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; a division by zero is 0."""
    c = lambda x: F.count_if(x)
    yes, said = F.col(y) == 1, F.col(p) == 1
    a = df.agg(c(yes & said).alias("tp"), c(~yes & said).alias("fp"), c(yes & ~said).alias("fn"), F.avg((F.col(y) == F.col(p)).cast("int")).alias("acc"))
    div = lambda x, z: F.round(F.coalesce(F.try_divide(x, z), F.lit(0.0)), 6)
    tp = F.col("tp")
    return a.select(F.round("acc", 6).alias("accuracy"), div(tp, tp + F.col("fp")).alias("precision"), div(tp, tp + F.col("fn")).alias("recall"), div(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    """mse, rmse, mae and r2 = 1 - SSE / SST (0 if SST is 0)."""
    e = F.col(y) - F.col(p)
    a = df.agg(F.avg(e * e).alias("m"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v"))
    return a.select(F.round("m", 4).alias("mse"), F.round(F.sqrt("m"), 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round(F.coalesce(1 - F.try_divide(F.col("m"), F.col("v")), F.lit(0.0)), 6).alias("r2"))


def average_rank(df: DataFrame, c: str, out: str) -> DataFrame:
    """Ranks with ties at their mean, from counts of distinct values dealt out by ranges."""
    of = ranks.counted(df.select(F.col(c).alias("_c")), "_c").select("_c", (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return df.join(of, F.col(c) == F.col("_c")).drop("_c")


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    r = df.agg(F.when(F.count("*") >= 2, F.corr(a, b)).alias("r"))
    return r.select(F.round(F.when(F.isnan("r"), F.lit(0.0)).otherwise(F.coalesce("r", F.lit(0.0))), 6).alias("r"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    return pearson(average_rank(average_rank(df.select(a, b), a, "_ra"), b, "_rb"), "_ra", "_rb")


def auroc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under ROC by Mann-Whitney with mean ranks; 0.5 if one class is missing."""
    r = average_rank(df.select(y, score), score, "_r")
    a = r.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"), F.sum(F.when(F.col(y) == 1, F.col("_r"))).alias("s"))
    return a.select(F.round(F.coalesce(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")), F.lit(0.5)), 6).alias("auroc"))


def threshold_probe(df: DataFrame, y: str, score: str, margin: float = 0.01) -> DataFrame:
    """The first threshold, from low to high, with the best F1 for score >= threshold: midpoints of distinct scores and two ends."""
    df, y, score = df.select(F.col(y).alias("_y"), F.col(score).alias("_score")), "_y", "_score"
    known = F.col(score).isNotNull()
    rows, hits, total = df.agg(F.count_if(known), F.sum(F.when(known, F.col(y))), F.sum(y)).first()
    n = ranks.counted(df, score, extra={"p": F.col(y)})
    f1 = F.round(F.coalesce(F.try_divide(2.0 * (F.lit(hits or 0) - F.col("p_before")), F.lit(rows + (total or 0)) - F.col("before")), F.lit(0.0)), 6)
    best = n.select(F.col(score).alias("_s"), f1.alias("f1")).orderBy(F.col("f1").desc(), "_s").first()
    if best is None:
        return df.sparkSession.createDataFrame([], "threshold double, f1 double")
    at = F.coalesce((F.max(F.when(F.col(score) < best["_s"], F.col(score))) + best["_s"]) / 2, F.lit(best["_s"] - margin))
    return df.agg(F.round(at.cast("double"), 6).alias("threshold"), F.lit(float(best["f1"])).alias("f1"))


def contingency(df: DataFrame, cluster: str, label: str) -> DataFrame:
    return df.groupBy(F.col(cluster).alias("c"), F.col(label).alias("l")).agg(F.count("*").alias("n"))


def purity(df, cluster, label):
    t = contingency(df, cluster, label)
    return t.groupBy("c").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg(F.round(F.sum("m") / F.sum("n"), 6).alias("purity"))


def nmi(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Mutual information over the arithmetic mean of both entropies."""
    t = contingency(df, cluster, label)
    n = float(t.agg(F.sum("n")).first()[0] or 1)
    h = lambda by, name: t.groupBy(by).agg(F.sum("n").alias("m")).agg((-F.sum(F.col("m") / n * F.log(F.col("m") / n))).alias(name))
    joint = t.agg((-F.sum(F.col("n") / n * F.log(F.col("n") / n))).alias("h"))
    s = h("c", "hc").join(h("l", "hl")).join(joint)  # three rows of one
    return s.select(F.round(F.coalesce(F.try_divide(F.col("hc") + F.col("hl") - F.col("h"), (F.col("hc") + F.col("hl")) / 2), F.lit(1.0)), 6).alias("nmi"))


def adjusted_rand(df: DataFrame, cluster: str, label: str) -> DataFrame:
    t = contingency(df, cluster, label)
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    of = lambda by, name: t.groupBy(by).agg(F.sum("n").alias("m")).agg(two("m").alias(name))
    s = t.agg(two("n").alias("i"), F.sum("n").alias("n")).join(of("c", "a")).join(of("l", "b"))
    e = F.col("a") * F.col("b") / (F.col("n") * (F.col("n") - 1) / 2)
    return s.select(F.round(F.coalesce(F.try_divide(F.col("i") - e, (F.col("a") + F.col("b")) / 2 - e), F.lit(1.0)), 6).alias("ari"))


#: name: (function of (df, truth, prediction), whether more is better)
METRICS = {
    "f1_macro": (f1_macro, True), "f1_weighted": (f1_weighted, True), "f1_micro": (f1_micro, True), "binary": (binary, True), "regression": (regression, False),
    "pearson": (pearson, True), "spearman": (spearman, True), "auroc": (auroc, True), "purity": (purity, True), "nmi": (nmi, True), "ari": (adjusted_rand, True),
}

"""Multi-label and ranking metrics over long relations: truth (row, label), scores (row, label, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """f1, precision, recall; null where undefined."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return F.try_divide(2 * p * r, p + r), p, r


def predicted(scores: DataFrame, threshold: float) -> DataFrame:
    """row, label of scores strictly above the threshold."""
    return scores.where(F.col("score") > threshold).select("row", "label")


def confusion(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """label, tp, fp, fn of distinct (row, label) pairs: one pass over both, marked by side."""
    t = truth.select("row", "label").distinct().withColumns({"t": F.lit(1), "p": F.lit(0)})
    p = predictions.select("row", "label").distinct().withColumns({"t": F.lit(0), "p": F.lit(1)})
    both = t.unionByName(p).groupBy("row", "label").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    return both.groupBy("label").agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum((1 - F.col("t")) * F.col("p")).alias("fp"), F.sum(F.col("t") * (1 - F.col("p"))).alias("fn"))


def micro(counts: DataFrame) -> DataFrame:
    total = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    a, p, r = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return total.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), a.alias("f1"))


def per_label(counts: DataFrame) -> DataFrame:
    a, p, r = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    # 0/0 in F1 of a label that is never hit is zero where precision and recall are both 0
    return counts.select("label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), a.alias("f1"))


def macro(counts: DataFrame) -> DataFrame:
    """Means over the labels for which the measure is defined."""
    return per_label(counts).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def ranked(scores: DataFrame) -> DataFrame:
    """row, label, score, rank: score descending, ties to the smaller label."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "label")))


def gains(scores: DataFrame, truth: DataFrame, p: int = 5) -> DataFrame:
    """row, cg, dcg, ndcg at p of every scored row. The ideal is that of 2^rel - 1; without a true label NDCG is 1."""
    top = ranked(scores).where(F.col("rank") <= p)
    t = truth.select("row", "label").distinct().withColumn("rel", F.lit(1.0))
    by = top.join(t, ["row", "label"], "left").groupBy("row").agg(F.sum(F.coalesce("rel", F.lit(0.0))).alias("cg"), F.sum(F.coalesce("rel", F.lit(0.0)) / F.log2(F.col("rank") + 1)).alias("dcg"))
    # true labels among the scored ones are what could have stood first
    n = scores.select("row", "label").distinct().join(t, ["row", "label"], "left_semi").groupBy("row").agg(F.least(F.count("*"), F.lit(p)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda a, k: a + 1 / F.log2(k + 1))
    return by.join(n, "row", "left").select("row", "cg", "dcg", F.when(F.col("n").isNull(), 1.0).otherwise(F.col("dcg") / ideal).alias("ndcg"))


def label_recall_at_k(scores: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """row, recall: the true labels among the top k over all true ones; rows without a true label are left out.

    Some call this measure precision at k.
    """
    t = truth.select("row", "label").distinct()
    hits = ranked(scores).where(F.col("rank") <= k).join(t, ["row", "label"], "left_semi").groupBy("row").agg(F.count("*").alias("hits"))
    return t.groupBy("row").agg(F.count("*").alias("n")).join(hits, "row", "left").select("row", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))


def score_summary(scores: DataFrame, truth: DataFrame, p: int = 5) -> DataFrame:
    g = gains(scores, truth, p).agg(F.avg("cg").alias("cg"), F.avg("dcg").alias("dcg"), F.avg("ndcg").alias("ndcg"))
    return g.crossJoin(label_recall_at_k(scores, truth, p).agg(F.avg("recall").alias("recall")))  # one row beside one row


def threshold_sweep(scores: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, f1 (0 where undefined): each score counts for all thresholds below it.

    Scores fall into the interval between two thresholds; a running sum from the top gives the counts of each.
    """
    grid = sorted(thresholds)
    steps = F.array(*[F.lit(float(t)) for t in grid])
    place = F.size(F.filter(steps, lambda t: t < F.col("score")))  # the thresholds that the score is above
    t = truth.select("row", "label").distinct()
    hit = scores.join(t.withColumn("rel", F.lit(1)), ["row", "label"], "left").select(place.alias("k"), F.coalesce("rel", F.lit(0)).alias("rel"))
    bins = hit.groupBy("k").agg(F.sum("rel").alias("tp"), F.sum(1 - F.col("rel")).alias("fp"))
    every = scores.sparkSession.createDataFrame([(k + 1, float(x)) for k, x in enumerate(grid)], "k int, threshold double")
    down = W.orderBy(F.desc("k"))  # as many rows as thresholds
    d = every.join(bins, "k", "left").withColumns({"tp": F.sum(F.coalesce("tp", F.lit(0))).over(down), "fp": F.sum(F.coalesce("fp", F.lit(0))).over(down)})
    d = d.crossJoin(t.agg(F.count("*").alias("positives"))).withColumn("fn", F.col("positives") - F.col("tp"))
    a, _, _ = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return d.select("threshold", "tp", "fp", "fn", F.coalesce(a, F.lit(0.0)).alias("f1"))


def best_threshold(scores: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """The first threshold of highest micro F1."""
    return threshold_sweep(scores, truth, thresholds).orderBy(F.desc("f1"), "threshold").limit(1)


def equality_accuracy(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")).alias("accuracy"))


def top_n_hits(ranking: DataFrame, n: int = 5) -> DataFrame:
    """accuracy: rows (row, name, rank, truth) whose true name is among the first n."""
    return ranking.groupBy("row").agg(F.max(((F.col("rank") <= n) & (F.col("name") == F.col("truth"))).cast("int")).alias("hit")).agg(F.avg("hit").alias("accuracy"))

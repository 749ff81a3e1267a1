"""Ranking metrics under three tie rules, multi-sentence retrieval and training losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(places: DataFrame, ties: str = "min") -> DataFrame:
    """(query_id, rank) from truth places: min counts higher scores only, ordinal breaks ties by id, expand gives one
    row for each tied position."""
    if ties == "min":
        return places.select("query_id", (F.col("greater") + 1).alias("rank"))
    if ties == "ordinal":
        return places.select("query_id", (F.col("greater") + F.col("before") + 1).alias("rank"))
    if ties == "expand":
        return places.select("query_id", F.explode(F.sequence(F.col("greater") + 1, F.col("greater") + F.col("equal"))).alias("rank"))
    raise ValueError(f"unknown tie rule {ties}")


def recall_metrics(ranks: DataFrame, lower_median: bool = False) -> DataFrame:
    """R@1, R@5, R@10 in percent, median and mean rank, population deviation, number of ranks."""
    recall = lambda k: (F.avg((F.col("rank") <= k).cast("double")) * 100).alias(f"r{k}")
    median = F.expr("percentile_disc(0.5) within group (order by rank)") if lower_median else F.median("rank")
    return ranks.agg(recall(1), recall(5), recall(10), median.cast("double").alias("median_rank"), F.avg("rank").alias("mean_rank"), F.round(F.stddev_pop("rank"), 6).alias("std_rank"), F.count("*").alias("n"))


def ranked(scores: DataFrame, of: str, by: str) -> DataFrame:
    """scores with the ordinal rank of each by within of, best first; NaN counts as the lowest score."""
    order = Window.partitionBy(of).orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), by)
    return scores.withColumn("rank", F.row_number().over(order).cast("long"))


def best_sentence(scores: DataFrame) -> DataFrame:
    """(group_id, video_id, score): the best sentence of each group for each video."""
    return scores.groupBy("group_id", "video_id").agg(F.max(F.nanvl("score", F.lit(float("-inf")))).alias("score"))


def _log_sum_exp(score: str, window) -> Column:
    """Shifted by the maximum, so that large scores don't overflow."""
    top = F.max(score).over(window)
    return F.log(F.sum(F.exp(F.col(score) - top)).over(window)) + top


def contrastive_loss(scores: DataFrame) -> DataFrame:
    """Mean over rows and columns of -log softmax at the diagonal; scores: (batch, q, v, score), q = v is the truth."""
    rows, columns = Window.partitionBy("batch", "q"), Window.partitionBy("batch", "v")
    both = scores.withColumn("lr", _log_sum_exp("score", rows)).withColumn("lc", _log_sum_exp("score", columns)).where("q = v")
    return both.groupBy("batch").agg(((F.avg(F.col("lr") - F.col("score")) + F.avg(F.col("lc") - F.col("score"))) / 2).alias("loss"))


def margin_loss(scores: DataFrame, margin: float, pairs: int = 1, hard_rate: float = 0.5) -> DataFrame:
    """Mean hinge of every pair against its row's and its column's truth.

    Where pairs of neighbouring rows belong to one clip (pairs above 1, and more than one clip in a batch), each hinge is
    weighted: n * hard_rate within a clip and n * (1 - hard_rate) / (n - 1) across, for n clips a batch.
    """
    truth = scores.where("q = v")
    both = scores.join(truth.select("batch", "q", F.col("score").alias("tq")), ["batch", "q"]).join(truth.select("batch", "v", F.col("score").alias("tv")), ["batch", "v"])
    hinge = lambda t: F.greatest(F.lit(0.0), F.lit(margin) + F.col("score") - F.col(t))
    weight = F.lit(1.0)
    if pairs > 1:
        clip = lambda c: F.floor(F.col(c) / F.lit(pairs))
        clips = truth.groupBy("batch").agg(F.count_distinct(clip("q")).alias("n"))
        both = both.join(clips, "batch")
        across = F.col("n") * (1 - hard_rate) / F.nullif(F.col("n") - 1, F.lit(0))
        weight = F.when(F.col("n") == 1, 1.0).when(clip("q") == clip("v"), F.col("n") * hard_rate).otherwise(across)
    return both.groupBy("batch").agg(F.avg((hinge("tq") + hinge("tv")) * weight).alias("loss"))


def nce_loss(scores: DataFrame) -> DataFrame:
    """-log of the truth's share among its row and column together, where the truth counts once; mean over the batch."""
    views = scores.select("batch", F.col("q").alias("k"), "score").union(scores.where("q <> v").select("batch", F.col("v").alias("k"), "score"))
    top = views.groupBy("batch", "k").agg(F.max("score").alias("top"))
    total = views.join(top, ["batch", "k"]).groupBy("batch", "k").agg((F.log(F.sum(F.exp(F.col("score") - F.col("top")))) + F.max("top")).alias("total"))
    truth = scores.where("q = v").select("batch", F.col("q").alias("k"), F.col("score").alias("t"))
    return total.join(truth, ["batch", "k"]).groupBy("batch").agg(F.avg(F.col("total") - F.col("t")).alias("loss"))


def group_members(sentences: DataFrame, by: str, order: str) -> DataFrame:
    """Of each group's sentences the last by order, whose clip stands for the group where clips are compared."""
    others = [c for c in sentences.columns if c != by]
    return sentences.groupBy(by).agg(F.max_by(F.struct(*others), order).alias("last")).select(by, "last.*")

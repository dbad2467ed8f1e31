"""Scored candidates per group: log-softmax, top-k with ties, nucleus.

A group may hold a large share of all rows, so none of these opens a window over a group's rows.
Groups and scores must not be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .ranks import running_sum


def with_log_softmax(df: DataFrame, group: str, score: str, out: str = "logp") -> DataFrame:
    """Adds the log-softmax of the score within its group.

    One pass sums exp(score - floor) by group and whole part of the score; the few sums of a group are
    then shifted by its largest whole part, so nothing overflows.
    """
    parts = df.groupBy(group, F.floor(score).cast("double").alias("_floor")).agg(
        F.sum(F.exp(F.col(score) - F.floor(score))).alias("_part")
    )
    tops = parts.groupBy(group).agg(F.max("_floor").alias("_top"))
    total = parts.join(tops, group).groupBy(group).agg(
        F.first("_top").alias("_top"), F.sum(F.col("_part") * F.exp(F.col("_floor") - F.col("_top"))).alias("_sum")
    )
    return (
        df.join(settled(total), group, "left")
        .withColumn(out, F.col(score) - F.col("_top") - F.log("_sum"))
        .drop("_top", "_sum")
    )


def target_logp(df: DataFrame, targets: DataFrame, group: str, cand: str, score: str) -> DataFrame:
    """(group, logp) at each group's target candidate, 0.0 where the target is ignored.

    ``targets`` holds one (group, target, ignored) per group.
    """
    at = with_log_softmax(df.select(group, cand, score), group, score).withColumnRenamed(cand, "target")
    return targets.join(at, [group, "target"], "left").select(
        group, "target", F.when(F.col("ignored"), 0.0).otherwise(F.col("logp")).alias("logp")
    )


def top_k(df: DataFrame, group: str, score: str, k: int) -> DataFrame:
    """Candidates at or above the k-th highest score of their group, ties kept.

    Distinct scores are counted, put in order by range partitions, and summed up to the k-th; no task
    holds a group, whatever k.
    """
    counts = df.groupBy(group, score).agg(F.count("*").alias("_n"))
    summed = running_sum(counts, [group], [F.desc(score)], F.col("_n"), "_upto")
    cut = summed.filter(F.col("_upto") - F.col("_n") < k).groupBy(group).agg(F.min(score).alias("_cut"))
    return df.join(settled(cut), group).filter(F.col(score) >= F.col("_cut")).drop("_cut")


def nucleus(df: DataFrame, group: str, cand: str, score: str, p: float) -> DataFrame:
    """Candidates whose preceding probability mass is at most ``p``; the first is always kept."""
    probs = with_log_softmax(df.select(group, cand, score), group, score).withColumn(
        "prob", F.exp("logp")
    )
    order = [F.desc(score), F.asc(cand)]
    summed = running_sum(probs.select(group, cand, score, "prob"), [group], order, F.col("prob"), "cum")
    return summed.filter(F.col("cum") - F.col("prob") <= p)

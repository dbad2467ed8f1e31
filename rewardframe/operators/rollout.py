"""Statistics over rollouts: advantages, KL, losses, step metrics.

Group figures come from a partial aggregate joined back to the rows, not from a window: a window
would pull a hot group into one task.  The figures (one row per group) are written out first: adaptive
execution splits a hot key only where both sides of a join are shuffled for the join itself, which an
aggregate on the same key is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled


def _standard(x: Column, mean: Column, sd: Column, eps: float) -> Column:
    """Standard score; 0.0 for a group of one or of equal values."""
    return F.when(sd > 0, (x - mean) / (sd + eps)).otherwise(F.lit(0.0))


def _with_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    # A left join keeps rows without a group; they have no figures and get advantage 0.
    return df.join(settled(stats), keys, "left")


def group_advantages(
    df: DataFrame, group: str | list[str], reward: str = "reward", eps: float = 1e-8, clamp: float = 10.0
) -> DataFrame:
    """Adds ``advantage``: the reward standardised within its group and clamped.

    Keep the frame narrow and settled (or a table): it is read once for the figures and once for
    the rows.
    """
    keys = [group] if isinstance(group, str) else group
    adv = _standard(F.col(reward), F.col("_mean"), F.col("_sd"), eps)
    adv = F.greatest(F.lit(-clamp), F.least(F.lit(clamp), adv))
    return _with_stats(df, keys, reward).withColumn("advantage", adv).drop("_mean", "_sd")


def batch_advantages(
    df: DataFrame, group: str | list[str], batch: str | list[str], reward: str = "reward"
) -> DataFrame:
    """Group advantages standardised once more over each batch."""
    inner = group_advantages(df, group, reward, eps=1e-4)
    keys = [batch] if isinstance(batch, str) else batch
    adv = _standard(F.col("advantage"), F.col("_mean"), F.col("_sd"), 1e-8)
    return _with_stats(inner, keys, "advantage").withColumn("advantage", adv).drop("_mean", "_sd")


def useful_steps(df: DataFrame, step: str | list[str], advantage: str = "advantage") -> DataFrame:
    """Rows of the steps whose advantages are not all zero.

    Keep the frame narrow and settled: it is read twice.  The steps left out are the smaller list as a rule, and a
    short list is sent to the rows instead of shuffling them.
    """
    keys = [step] if isinstance(step, str) else step
    size = F.sum(F.abs(advantage))
    dead = df.groupBy(*keys).agg(F.coalesce(size == 0, F.lit(True)).alias("_dead")).filter("_dead")
    for k in keys:  # a row without a step belongs to none
        df = df.filter(F.col(k).isNotNull())
    return df.join(settled(dead.select(*keys)), keys, "left_anti")


def with_gold(completions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Gold answer of the prompt on each of its completions, null where the prompt has none."""
    return completions.join(gold, key, "left")


def masked_sum(x: Column, mask: Column) -> Column:
    return F.aggregate(F.zip_with(x, mask, lambda a, m: a * m), F.lit(0.0), lambda s, v: s + v)


def masked_mean(x: Column, mask: Column, least: float = 1e-8) -> Column:
    """Mean where the mask is 1; the denominator is at least ``least``."""
    n = F.aggregate(mask, F.lit(0.0), lambda s, v: s + v)
    return masked_sum(x, mask) / F.greatest(n, F.lit(least))


def sequence_kl(pi: Column, ref: Column, mask: Column) -> Column:
    """Mean log-probability difference over the generated tokens."""
    return masked_mean(F.zip_with(pi, ref, lambda p, r: p - r), mask, 1.0)


def token_kl(pi: Column, ref: Column) -> Column:
    """Non-negative KL estimate per token: exp(d) - d - 1 with d = ref - pi."""
    return F.zip_with(pi, ref, lambda p, r: F.exp(r - p) - (r - p) - 1.0)


def sequence_loss(pi: Column, ref: Column, mask: Column, advantage: Column, beta: float) -> Column:
    """Mean over generated tokens of -(advantage - beta * KL); the probability ratio is 1 in value."""
    per_token = F.transform(token_kl(pi, ref), lambda k: k * beta - advantage)
    return masked_mean(per_token, mask, 1.0)


def loss_and_kl(df: DataFrame, beta: float, keys: list[str] | None = None) -> DataFrame:
    """Mean loss, non-negative KL and signed KL over sequences (pi, ref, mask, advantage)."""
    pi, ref, mask = F.col("pi"), F.col("ref"), F.col("mask")
    per = df.select(
        *(keys or []),
        sequence_loss(pi, ref, mask, F.col("advantage"), beta).alias("_loss"),
        masked_mean(token_kl(pi, ref), mask, 1.0).alias("_kl"),
        sequence_kl(pi, ref, mask).alias("_signed"),
    )
    return per.groupBy(*(keys or [])).agg(
        F.avg("_loss").alias("loss"), F.avg("_kl").alias("kl_mean"), F.avg("_signed").alias("kl_signed")
    )


def step_metrics(
    df: DataFrame, keys: list[str], reward: str = "reward", advantage: str = "advantage",
    length: str | None = None, seconds: str | None = None,
) -> DataFrame:
    """Reward and advantage figures per step; response length and step time where columns are named."""
    aggs = [
        F.count("*").alias("n"),
        F.avg(reward).alias("reward_mean"),
        F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("reward_std"),
        F.avg(advantage).alias("advantage_mean"),
        F.min(advantage).alias("advantage_min"),
        F.max(advantage).alias("advantage_max"),
    ]
    if length:
        aggs.append(F.avg(length).alias("response_length"))
    if seconds:
        aggs.append((F.max(seconds) - F.min(seconds)).alias("step_seconds"))
    return df.groupBy(*keys).agg(*aggs)


def validation_reward(df: DataFrame, batch: str, reward: str, max_steps: int = 20) -> DataFrame:
    """Mean reward over the first ``max_steps`` batches (numbered from 0), 0.0 without rows."""
    return df.filter(F.col(batch) < max_steps).agg(
        F.coalesce(F.avg(reward), F.lit(0.0)).alias("mean_reward"), F.count("*").alias("n")
    )


def compare_methods(df: DataFrame, method: str, fmt: str, accuracy: str) -> DataFrame:
    return df.groupBy(method).agg(
        F.avg(fmt).alias("mean_format"), F.avg(accuracy).alias("mean_accuracy"), F.count("*").alias("n")
    )


def eval_summary(df: DataFrame, latency: str = "latency_s") -> DataFrame:
    """Sample count, total and mean latency of an evaluation run."""
    n = F.count("*")
    total = F.coalesce(F.sum(latency), F.lit(0.0))
    return df.agg(
        n.alias("samples"), total.alias("total_s"), (total / F.greatest(n, F.lit(1))).alias("mean_s")
    )

"""Reproducible splits, epoch plans and prompt repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_percent
from .ranks import hash_rank


def in_split(sample_id: Column, split: str, val_ratio: float = 0.02, seed: str = "split") -> Column:
    """Condition that a sample belongs to ``train``, ``val`` or ``all``."""
    share = stable_percent(seed, sample_id)
    threshold = int(val_ratio * 10000)
    if split == "all":
        return F.lit(True)
    if split == "val":
        return share < threshold
    if split == "train":
        return share >= threshold
    raise ValueError(f"unknown split: {split}")


def epoch_plan(
    df: DataFrame, id_col: str, seed: int, epoch: int, batch_size: int,
    shards: int = 1, skip_batches: int = 0,
) -> DataFrame:
    """Shard and batch number of every sample in the epoch's seeded order.

    Positions are dealt to shards in turn; as in distributed samplers the rows repeat from the first
    until every shard has equally many, as often as that takes.  A final short batch is kept, skipped ones are not.
    """
    digest = F.md5(F.concat(F.lit(f"{seed + epoch}-"), F.col(id_col).cast("string")))
    order = hash_rank(df.select(id_col), digest, [id_col])
    if shards > 1:
        total = df.agg(F.count("*")).scalar()
        at = F.col("position")
        upto = F.ceil(total / shards) * shards
        order = order.withColumn("position", F.explode(F.sequence(at, upto - 1, total)))
    in_shard = F.floor(F.col("position") / shards)
    return (
        order.withColumn("shard", (F.col("position") % shards).cast("int"))
        .withColumn("batch", F.floor(in_shard / batch_size).cast("bigint"))
        .filter(F.col("batch") >= skip_batches)
    )


def batch_count(samples: int, batch_size: int, skip_batches: int = 0) -> int:
    return max(0, -(-samples // batch_size) - skip_batches)


def resume_step(step: int, old_shards: int, new_shards: int) -> int:
    """Step to resume from when the number of shards has changed."""
    return step * old_shards // new_shards if old_shards != new_shards else step


def repeat_prompts(df: DataFrame, times: int, order: str = "prompt") -> DataFrame:
    """Each prompt ``times`` times, numbered ``g``.

    ``slot`` names the row's place within a batch that carries a ``row`` number: all copies of a
    prompt together (``prompt``), or all prompts of one copy together (``generation``).
    """
    out = df.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if "row" not in df.columns:
        return out
    if order == "prompt":
        return out.withColumn("slot", F.col("row") * times + F.col("g"))
    return out.withColumn("slot", F.col("g") * F.col("batch_rows") + F.col("row"))

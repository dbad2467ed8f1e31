"""Collation of token arrays into batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import IGNORE, pad_left


def collate(df: DataFrame, batch: str, ids: str, max_length: int, pad: int) -> DataFrame:
    """Ids cut to ``max_length`` and left-padded to the longest of the batch, with attention mask.

    Batches come from a plan with a fixed batch size, so the window holds few rows.
    """
    longest = F.max(F.size("_cut")).over(Window.partitionBy(batch))
    return (
        df.withColumn("_cut", F.slice(ids, 1, max_length))
        .withColumn("_width", longest)
        .withColumn(
            "attention_mask",
            F.concat(
                F.array_repeat(F.lit(0), F.col("_width") - F.size("_cut")),
                F.array_repeat(F.lit(1), F.size("_cut")),
            ),
        )
        .withColumn("input_ids", pad_left(F.col("_cut"), F.col("_width"), pad))
        .drop("_cut", "_width")
    )


def assemble(df: DataFrame, batch: str, prompt: str, completion: str, pad: int) -> DataFrame:
    """Prompt and completion ids side by side, padded to the batch's longest prompt plus completion,
    with attention mask and labels on the completion alone."""
    over = Window.partitionBy(batch)
    p, c = F.col(prompt), F.col(completion)
    used = F.size(p) + F.size(c)
    gap = F.col("_width") - used
    return (
        df.withColumn("_width", F.max(F.size(p)).over(over) + F.max(F.size(c)).over(over))
        .withColumn("full_ids", F.concat(p, c, F.array_repeat(F.lit(pad), gap)))
        .withColumn(
            "attention_mask", F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), gap))
        )
        .withColumn(
            "labels",
            F.concat(F.array_repeat(F.lit(IGNORE), F.size(p)), c, F.array_repeat(F.lit(IGNORE), gap)),
        )
        .drop("_width")
    )

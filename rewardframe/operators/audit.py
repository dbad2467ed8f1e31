"""Dataset audit: one global aggregate over the parsed conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import IMAGE_TAG, conversation, image_lengths, image_state_of, is_question
from ..functions.text import strip


def percentile_or_zero(c: Column, p: float) -> Column:
    """Linear-interpolation percentile of a non-null column, 0.0 for no values.

    The aggregate keeps one counter per distinct value; used here on text lengths, whose number of
    distinct values is bounded by the longest text.
    """
    return F.coalesce(F.percentile(c, p), F.lit(0.0))


def parsed(df: DataFrame, conv: str = "conversations", images: str = "images") -> DataFrame:
    """Adds ``conv`` (user, assistant, state) and ``image_state``.

    A table with ``image_lengths`` (see ``write_chats``) is judged by them, and its images are not read.
    """
    return df.withColumn("conv", conversation(F.col(conv))).withColumn(
        "image_state", image_state_of(_lengths(df, images))
    )


def _lengths(df: DataFrame, images: str) -> Column:
    return F.col("image_lengths") if "image_lengths" in df.columns else image_lengths(F.col(images))


def audit(df: DataFrame, conv: str = "conversations", images: str = "images") -> DataFrame:
    """One row of audit figures; zero denominators count as one."""
    img = _lengths(df, images)
    rows = parsed(df, conv, images).select(
        "image_state", F.col("conv.state").alias("state"),
        strip(F.col("conv.user")).alias("user"), strip(F.col("conv.assistant")).alias("assistant"),
        (img.isNull() | (F.size(img) == 0)).alias("no_images"),
    ).select(
        "image_state", "state", "no_images",
        F.length("user").alias("user_len"), F.length("assistant").alias("assistant_len"),
        F.col("user").rlike(IMAGE_TAG).alias("tagged"), is_question(F.col("user")).alias("asks"),
    )
    total, good = F.count("*"), F.count_if(F.col("state") == "ok")
    ratio = lambda n, d: n / F.greatest(d, F.lit(1))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return rows.agg(
        total.alias("total_samples"),
        ratio(good, total).alias("parseable_ratio"),
        ratio(F.count_if(F.col("image_state") == "single"), total).alias("single_image_ratio"),
        *[
            f.alias(f"{side}_length_{name}")
            for side in ("user", "assistant")
            for name, f in (
                ("mean", mean(f"{side}_len")),
                ("p50", percentile_or_zero(F.col(f"{side}_len"), 0.5)),
                ("p90", percentile_or_zero(F.col(f"{side}_len"), 0.9)),
            )
        ],
        ratio(F.count_if("tagged"), good).alias("user_image_ratio"),
        ratio(F.count_if("asks"), good).alias("user_question_ratio"),
        F.count_if(F.col("state") == "empty_text").alias("anomaly_empty_text"),
        F.count_if("no_images").alias("anomaly_no_image_bytes"),
        F.count_if(F.col("state").isin("json_error", "non_standard")).alias("anomaly_non_standard"),
    )

"""Distillation: ordered drop funnel, rewritten chats, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import looks_like_caption, normal_user, question_text, worth_asking
from ..functions.distilling import (
    ANSWER_FOCUSED, EVAL_STYLE, answer_too_long, chat_json, distilled_text, explanation_lines,
    same_text_similarity, think_lines,
)
from ..functions.prompts import distill_prompt
from ..functions.text import let, strip
from .audit import parsed

# Drop reasons in the order the rules run.
CALL_FREE_REASONS = (
    "non_standard_structure", "empty_text", "no_image_bytes", "non_single_image",
    "not_question_or_too_short", "caption_like",
)
REPLY_REASONS = (
    "api_fail", "no_think", "no_answer", "answer_too_long", "answer_focused_explanation",
    "explanation_eval_style", "too_short", "inconsistent_answer",
)


@dataclass(frozen=True)
class DistillRules:
    min_user_len: int = 15
    min_total_len: int = 40
    min_think_lines: int = 1
    max_answer_ratio: float = 1.2
    similarity_threshold: float = 0.85


def _first_failing(rules: list[tuple[str, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for reason, fails in reversed(rules):
        out = F.when(fails, F.lit(reason)).otherwise(out)
    return out


def candidates(df: DataFrame, rules: DistillRules = DistillRules()) -> DataFrame:
    """Parsed chats with the first call-free drop reason, the question and the distill prompt.

    Rows without a reason are the ones worth a call.
    """
    state, image = F.col("conv.state"), F.col("image_state")
    question = F.col("question")
    reason = _first_failing([
        ("non_standard_structure", state.isin("json_error", "non_standard")),
        ("empty_text", state == "empty_text"),
        ("no_image_bytes", image == "no_image_bytes"),
        ("non_single_image", image == "multi"),
        ("not_question_or_too_short",
         ~worth_asking(question, rules.min_user_len)),
        ("caption_like", looks_like_caption(question)),
    ])
    return (
        parsed(df)
        .withColumn("new_user", normal_user(F.col("conv.user")))
        .withColumn("question", question_text(F.col("new_user")))
        .withColumn("early_reason", reason)
        .withColumn("ref_answer", strip(F.col("conv.assistant")))
        .withColumn(
            "prompt", F.when(F.col("early_reason").isNull(), distill_prompt(question, F.col("ref_answer")))
        )
    )


def _reply_outcome(reply: Column, ref: Column, rules: DistillRules) -> Column:
    """Struct (reason, made, n_lines, similarity) of a reply; a null reason passes every rule."""

    def checked(x: Column) -> Column:
        explanation, made = F.array_join(x["shown"], " "), x["made"]
        short = (F.length(made) < rules.min_total_len) | (F.size(x["shown"]) < rules.min_think_lines)
        # The answer is carried over from the reference, so its similarity is that of equal texts.
        sim = same_text_similarity(ref, ref)
        reason = _first_failing([
            ("api_fail", F.coalesce(reply, F.lit("")) == ""),
            ("no_think", x["n"] == 0),
            ("no_answer", ref == ""),
            ("answer_too_long", answer_too_long(ref, ref, rules.max_answer_ratio)),
            ("answer_focused_explanation", explanation.rlike(ANSWER_FOCUSED)),
            ("explanation_eval_style", explanation.rlike(EVAL_STYLE)),
            ("too_short", short),
            ("inconsistent_answer", sim < rules.similarity_threshold),
        ])
        return F.struct(
            reason.alias("reason"), made.alias("made"), F.size(x["shown"]).alias("n_lines"),
            sim.alias("similarity"),
        )

    def shown(x: Column) -> Column:
        return F.struct(
            x["n"].alias("n"), x["made"].alias("made"), explanation_lines(x["made"]).alias("shown")
        )

    def made(kept: Column) -> Column:
        return F.struct(F.size(kept).alias("n"), distilled_text(kept, ref).alias("made"))

    return let(let(let(think_lines(reply), made), shown), checked)


def funnel(
    df: DataFrame, replies: DataFrame, key: str = "id", rules: DistillRules = DistillRules()
) -> DataFrame:
    """Chats with ``drop_reason`` (``keep`` for survivors), the new assistant text and its figures.

    ``replies`` holds (key, reply[, latency]).  Only texts take part in the join; images and other
    columns are joined back by :func:`kept_chats` for the survivors alone.
    """
    cand = candidates(df, rules).select(key, "early_reason", "new_user", "ref_answer")
    answers = replies.select(
        key, "reply",
        (F.col("latency") if "latency" in replies.columns else F.lit(None).cast("double")).alias("latency"),
    )
    out = F.col("outcome")
    rows = cand.join(answers, key, "left").withColumn(
        "outcome", _reply_outcome(F.col("reply"), F.col("ref_answer"), rules)
    )
    reason = F.coalesce(F.col("early_reason"), out["reason"], F.lit("keep"))
    return rows.withColumn("drop_reason", reason).select(
        key, "drop_reason", "early_reason", "new_user", out["made"].alias("new_assistant"), "latency",
        out["n_lines"].alias("n_lines"),
        F.when(F.col("drop_reason").isin("keep", "inconsistent_answer"), out["similarity"]).alias("similarity"),
    )


def kept_chats(
    df: DataFrame, funnelled: DataFrame, key: str = "id", rules: DistillRules = DistillRules()
) -> DataFrame:
    """Survivors with the rewritten conversation; every other input column unchanged.

    The call-free rules run again on the scan, so that only rows worth a call carry their image bytes
    into the join.
    """
    new = funnelled.filter(F.col("drop_reason") == "keep").select(
        key, chat_json(F.col("new_user"), F.col("new_assistant")).alias("_new")
    )
    cols = [F.col("_new").alias(c) if c == "conversations" else F.col(c) for c in df.columns]
    asked = candidates(df, rules).filter(F.col("early_reason").isNull()).select(*df.columns)
    return asked.join(new, key).select(*cols)


def drop_counts(funnelled: DataFrame) -> DataFrame:
    return funnelled.groupBy("drop_reason").agg(F.count("*").alias("n"))


def distill_report(funnelled: DataFrame) -> DataFrame:
    """One row: keep ratio, call count, consistency, averages and a count per drop reason."""
    n = lambda cond: F.count_if(cond)
    reason = F.col("drop_reason")
    total, keep, called = F.count("*"), n(reason == "keep"), n(F.col("early_reason").isNull())
    over = lambda a, b: a / F.greatest(b, F.lit(1))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    kept = reason == "keep"
    return funnelled.agg(
        total.alias("total"), keep.alias("keep"), over(keep, total).alias("keep_ratio"),
        called.alias("api_called"),
        over(n(reason == "answer_focused_explanation"), called).alias("answer_focused_explanation_rate"),
        mean(F.when(F.col("early_reason").isNull(), F.col("latency"))).alias("avg_api_latency_sec"),
        mean(F.when(kept, F.col("n_lines"))).alias("avg_think_lines"),
        over(keep, keep + n(reason == "inconsistent_answer")).alias("answer_consistency_rate"),
        mean("similarity").alias("avg_answer_similarity"),
        *[n(reason == r).alias(f"drop_{r}") for r in (*REPLY_REASONS, *CALL_FREE_REASONS)],
    )

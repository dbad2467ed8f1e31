"""Scoring jobs: the reward router, composite rewards, rule scores, gated accuracy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats, markup, maths, rules
from ..functions.choices import relaxed_match
from ..functions.extract import before_last_close, last_answer, last_answer_in, plain_answer, tagged_answer
from ..functions.text import apart, collapsed_lower, flag, strip, strip_read, text


@dataclass(frozen=True)
class Paired:
    """A rule over two texts made from (last answer, completion, gold), which become columns before they are scored.

    ``score`` takes (made, ref, last answer, gold) and may mention them as often as it likes.
    """

    texts: Callable[[Column, Column, Column], tuple[Column, Column]]
    score: Callable[[Column, Column, Column, Column], Column]


# A rule takes (last answer, completion, gold) and gives a double; register more under new names.
Rule = Callable[[Column, Column, Column], Column] | Paired

RULES: dict[str, Rule] = {
    "NUMBER": lambda pred, c, gold: rules.number_match(pred, gold),
    "MATH_EXPRESSIONS": Paired(
        lambda pred, c, gold: (F.lower(maths.unwrapped(text(pred))), F.lower(text(gold))),
        lambda made, ref, pred, gold: flag(maths.method_of(made, ref) != "none"),
    ),
    "HTML_CODE": Paired(
        lambda pred, c, gold: (markup.html_code(c, pred), strip_read(gold)),
        lambda made, ref, pred, gold: markup.html_score_of(made, ref),
    ),
    "SVG_CODE": Paired(
        lambda pred, c, gold: (markup.svg_code(c, pred), strip_read(gold)),
        lambda made, ref, pred, gold: markup.svg_score_of(made, ref),
    ),
    "BOOLEAN": Paired(
        lambda pred, c, gold: (F.lower(pred), F.lower(gold)),
        lambda made, ref, pred, gold: rules.truth_match(pred, made, ref),
    ),
    "MULTIPLE_CHOICE": lambda pred, c, gold: rules.choice_match(pred, gold),
    "OCRTEXT": Paired(
        lambda pred, c, gold: (collapsed_lower(pred), collapsed_lower(gold)),
        lambda made, ref, pred, gold: rules.nearness(pred, made, ref, gold),
    ),
    "BBOX": lambda pred, c, gold: rules.box_iou(pred, gold),
    "CRITIC": lambda pred, c, gold: rules.exact_match(pred, gold),
    "ANY": lambda pred, c, gold: rules.string_match(pred, gold),
}
# Types scored by a job of their own; their score comes in as a column.
JOINED_TYPES = ("GENERAL_CODE", "JUDGE")
MODES = ("TYPE_BASED_JUDGE", "ALL_JUDGE", "TYPE_BASED_RULE")


def uses_judge(answer_type: Column, mode: str = "TYPE_BASED_JUDGE") -> Column:
    """Rows the router sends to the judge under a mode."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "ALL_JUDGE":
        return F.lit(True)
    judge = F.coalesce(answer_type == "JUDGE", F.lit(False))
    if mode == "TYPE_BASED_RULE":
        return judge
    known = F.coalesce(answer_type.isin(*RULES, "GENERAL_CODE"), F.lit(False))
    return judge | ~known


def routed_rewards(
    df: DataFrame, mode: str = "TYPE_BASED_JUDGE", judge: Column | None = None, code: Column | None = None,
) -> DataFrame:
    """Adds ``acc_reward``, ``bbox_reward`` and ``reward`` from completion, answer, answer_type and
    problem_type.

    ``judge`` and ``code`` are score columns of the judge and code-test jobs.  Without a judge its
    rows fall back to string matching; without executed tests code scores zero.
    """
    pred, c, gold = F.col("_pred"), text("completion"), F.col("answer")
    kind = F.col("answer_type")
    made = ref = F.lit(None).cast("string")
    plain = rules.string_match(pred, gold)
    by_judge = F.coalesce(judge, plain) if judge is not None else plain
    score = plain
    for name, rule in reversed(RULES.items()):
        if isinstance(rule, Paired):
            own = rule.score(F.col("_made"), F.col("_ref"), pred, gold)
            texts = rule.texts(pred, c, gold)
            made, ref = F.when(kind == name, texts[0]).otherwise(made), F.when(kind == name, texts[1]).otherwise(ref)
        else:
            own = rule(pred, c, gold)
        score = F.when(F.col("_kind") == name, own).otherwise(score)
    code_score = F.coalesce(code, F.lit(0.0)) if code is not None else F.lit(0.0)
    score = F.when(F.col("answer_type") == "GENERAL_CODE", code_score).otherwise(score)
    acc = F.when(uses_judge(F.col("answer_type"), mode), by_judge).otherwise(score)
    box = F.when(F.col("problem_type") == "SPATIAL_REASONING", formats.think_has_box(c)).otherwise(0.0)
    return (
        df.withColumn("_before", before_last_close(c))
        .withColumn("_pred", last_answer_in(F.col("_before"), c))
        .withColumns({"_made": made, "_ref": ref, "_kind": apart(kind)})
        .withColumn("acc_reward", acc)
        .withColumn("bbox_reward", box)
        .withColumn("reward", F.col("acc_reward") + 0.5 * F.col("bbox_reward"))
        .drop("_before", "_pred", "_made", "_ref", "_kind")
    )


def judged_rewards(df: DataFrame, judged: DataFrame, key: Column, mode: str = "TYPE_BASED_JUDGE") -> DataFrame:
    """As :func:`routed_rewards`, with the judge's scores from a table (key, score) of one row per key.

    Only rows that the mode sends to the judge are joined, and so shuffled; the others are scored where they are read.
    """
    asked = uses_judge(F.col("answer_type"), mode)
    found = judged.select(F.col("key").alias("_key"), F.col("score").alias("_score"))
    own = routed_rewards(df.filter(~asked), mode)
    joined = df.filter(asked).withColumn("_key", key).join(found, "_key", "left")
    return own.unionByName(routed_rewards(joined, mode, judge=F.col("_score")).drop("_key", "_score"))


@dataclass(frozen=True)
class CompositeWeights:
    format: float = 0.4
    tag: float = 0.2
    answer: float = 0.4
    judge: float = 0.2


def type_based_answer(pred: Column, gold: Column, answer_type: Column) -> Column:
    """Number matching where the type says number, string matching elsewhere."""
    numeric = F.lower(text(answer_type)).contains("number")
    gold = text(gold)
    return F.when(numeric, rules.number_match(pred, gold)).otherwise(rules.string_match(pred, gold))


def composite_rewards(
    df: DataFrame, weights: CompositeWeights = CompositeWeights(), judge: Column | None = None
) -> DataFrame:
    """Adds format, tag and answer rewards and their weighted sum ``reward``."""
    c = text("completion")
    total = (
        weights.format * F.col("format_reward") + weights.tag * F.col("tag_reward")
        + weights.answer * F.col("answer_reward")
    )
    if judge is not None:
        total = total + weights.judge * F.coalesce(judge, F.lit(0.0))
    return (
        df.withColumn("_pred", last_answer(c))
        .withColumn("format_reward", formats.xml_format(c))
        .withColumn("tag_reward", formats.tag_count_score(c))
        .withColumn("answer_reward", type_based_answer(F.col("_pred"), F.col("answer"), F.col("answer_type")))
        .withColumn("reward", total)
        .drop("_pred")
    )


def rule_scores(df: DataFrame, judge: Column | None = None, format_weight: float = 0.1) -> DataFrame:
    """Adds predicted and gold text, accuracy, format score and their weighted ``score``.

    Accuracy is relaxed matching, then numeric equality, then the judge score where one is given.
    """
    pred, gold = F.col("predict_str"), F.col("ground_truth")
    relaxed = relaxed_match(pred, gold)
    acc = F.coalesce(
        F.nullif(relaxed, F.lit(0.0)), F.when(maths.math_equal(pred, gold), 1.0),
        judge if judge is not None else F.lit(0.0), F.lit(0.0),
    )
    return (
        df.withColumn("_tagged", tagged_answer(F.col("completion")))
        .withColumn("predict_str", plain_answer(strip(F.col("_tagged"))))
        .withColumn("ground_truth", plain_answer(F.col("answer")))
        .withColumn("acc_score", acc)
        .withColumn("format_score", formats.format_score(F.col("completion"), F.col("_tagged")))
        .withColumn(
            "score", (1 - format_weight) * F.col("acc_score") + format_weight * F.col("format_score")
        )
        .drop("_tagged")
    )


def gated_accuracy(
    df: DataFrame, judged: DataFrame | Column, key: list[str], w_format: float = 1.0, w_acc: float = 1.0
) -> DataFrame:
    """Total of the strict format reward and the judge's accuracy.

    ``judged`` holds (key, accuracy) for rows that passed the format; the others score zero with a
    reason, so no judge call is spent on them.  A judge that is an expression is given as a column: it is
    computed where the format holds, in the same pass over the rows.
    """
    rows = df.withColumn("format_reward", formats.strict_format(F.col("completion"))["reward"])
    passed = F.col("format_reward") > 0
    if isinstance(judged, Column):
        rows = rows.withColumn("accuracy", F.when(passed, judged))
    else:
        rows = rows.join(judged.select(*key, "accuracy"), key, "left")
    acc = F.when(passed, F.coalesce(F.col("accuracy"), F.lit(0.0))).otherwise(0.0)
    return (
        rows.withColumn("accuracy", acc)
        .withColumn("skipped", ~passed)
        .withColumn("reason", F.when(~passed, F.lit("format_reward_zero")))
        .withColumn("reward", w_format * F.col("format_reward") + w_acc * F.col("accuracy"))
    )


def needs_judging(df: DataFrame) -> DataFrame:
    """Rows whose strict format holds; filter here, before any judge job."""
    return df.filter(formats.strict_format(F.col("completion"))["reward"] > 0)

"""Judge requests and replies: question types, the built-in rule judge, reply parsing, weighting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .enhanced import NORMAL_WEIGHTS, THINKING_WEIGHTS
from .text import all_matches, first_match, has_any, let, strip, text

# Key words and answer types that decide the question type.
REASON_WORDS = ("reason", "explain", "why", "how")
CODE_WORDS = ("code", "program", "function")
MATH_TYPES = ("NUMBER", "MATH_EXPRESSIONS")
CODE_TYPES = ("HTML_CODE", "SVG_CODE", "GENERAL_CODE")
MAP_JSON = "map<string,string>"


def question_type_by_text(data_source: Column, question: Column) -> Column:
    q = F.lower(text(question))
    return (
        F.when(F.lower(text(data_source)).contains("math"), F.lit("math"))
        .when(has_any(q, REASON_WORDS), F.lit("reasoning"))
        .when(has_any(q, CODE_WORDS), F.lit("coding"))
        .otherwise(F.lit("general"))
    )


def question_type_by_answer(prompt: Column, answer_type: Column) -> Column:
    return (
        F.when(answer_type.isin(*MATH_TYPES), F.lit("math"))
        .when(answer_type.isin(*CODE_TYPES), F.lit("coding"))
        .when(has_any(F.lower(text(prompt)), ("reason", "explain")), F.lit("reasoning"))
        .otherwise(F.lit("general"))
    )


def rule_judge(prompt: Column, completion: Column, answer: Column) -> Column:
    """Struct (score, explanation) by containment; short completions lose a tenth."""
    return let(
        F.struct(
            text(prompt).alias("prompt"), text(completion).alias("completion"), text(answer).alias("gold"),
            all_matches(text(completion), r"\*\*boxed\{([^}]+)\}", 1).alias("boxes"),
        ),
        lambda x: _verdict(x["prompt"], x["completion"], x["gold"], x["boxes"]),
    )


def _verdict(prompt: Column, completion: Column, gold: Column, boxes: Column) -> Column:
    low_gold, low = strip(F.lower(gold)), F.lower(completion)
    boxed = F.exists(boxes, lambda b: strip(F.lower(b)) == low_gold)
    cases = (
        (gold == "", 0.5, F.lit("Neutral score")),
        (F.contains(completion, gold), 1.0,
         F.concat(F.lit("Correct answer '"), gold, F.lit("' found in completion"))),
        (F.contains(low, low_gold), 0.8, F.lit("Answer variant found (subtle difference)")),
        (~completion.contains("**boxed{"), 0.0,
         F.concat(F.lit("Answer '"), gold, F.lit("' not found in completion"))),
        (F.size(boxes) == 0, 0.5, F.lit("Neutral score")),
        (boxed, 0.9, F.lit("Answer found in boxed format")),
        (F.lit(True), 0.0,
         F.concat(F.lit("Boxed content doesn't match: "), F.get(boxes, F.lit(0)), F.lit(" vs "), gold)),
    )
    score, why = F.lit(0.0), F.lit("")
    for cond, value, reason in reversed(cases):
        score = F.when(cond, F.lit(value)).otherwise(score)
        why = F.when(cond, reason).otherwise(why)
    short = F.when(F.length(completion) < F.length(prompt), 0.9).otherwise(1.0)
    return F.struct((score * short).alias("score"), why.alias("explanation"))


def _as_map(c: Column) -> Column:
    """Fields of a JSON object; null for anything else."""
    return F.when(c.startswith("{") & F.try_parse_json(c).isNotNull(), F.from_json(c, MAP_JSON))


def _unit(m: Column, key: str) -> Column:
    raw = F.try_element_at(m, F.lit(key))
    value = F.when(raw == "true", 1.0).otherwise(raw.try_cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def judge_scores(reply: Column) -> Column:
    """Struct (reasoning, answer, total, error) of a two-score reply, each clamped to [0, 1]."""


    def fields(s: Column) -> Column:
        inner = let(first_match(s, r"\{[\s\S]*?\}", 0), _as_map)
        m = F.when(F.try_parse_json(s).isNotNull(), _as_map(s)).otherwise(inner)
        return F.struct((s == "").alias("empty"), m.alias("m"))

    def scores(x: Column) -> Column:
        r = F.when(x["m"].isNull(), 0.0).otherwise(_unit(x["m"], "reasoning"))
        a = F.when(x["m"].isNull(), 0.0).otherwise(_unit(x["m"], "answer"))
        error = F.when(x["empty"], F.lit("empty_response")).when(
            x["m"].isNull(), F.lit("json_parse_failed")
        )
        return F.struct(
            r.alias("reasoning"), a.alias("answer"), (r + a).alias("total"), error.alias("error")
        )

    return let(let(strip(text(reply)), fields), scores)


def judge_detail(reply: Column) -> Column:
    """Struct of the detailed reply: JSON fields, else the first decimal as the score, else zeros."""
    parts = lambda s: F.struct(_as_map(s).alias("m"), first_match(s, r"\d+\.\d+", 0).alias("d"))
    return let(let(strip(text(reply)), parts), lambda x: _detail(x["m"], x["d"]))


def _detail(m: Column, decimal: Column) -> Column:
    is_map, has_decimal = m.isNotNull(), decimal.isNotNull()

    def field(key: str, default: float, from_decimal: Column) -> Column:
        value = F.try_element_at(m, F.lit(key)).try_cast("double")
        return (
            F.when(is_map, F.coalesce(value, F.lit(default)))
            .when(has_decimal, from_decimal)
            .otherwise(F.lit(0.0))
        )

    score = decimal.try_cast("double")
    why = (
        F.when(is_map, F.coalesce(F.try_element_at(m, F.lit("explanation")), F.lit("")))
        .when(has_decimal, F.concat(F.lit("Parse error, extracted score: "), decimal))
        .otherwise(F.lit("Failed to parse judge response"))
    )
    return F.struct(
        field("total_score", 0.0, score).alias("score"),
        field("reasoning_score", 0.0, F.lit(0.0)).alias("reasoning_score"),
        field("answer_score", 0.0, score).alias("answer_score"),
        field("format_score", 0.0, F.lit(0.0)).alias("format_score"),
        why.alias("explanation"),
        field("confidence", 0.8, F.lit(0.6)).alias("confidence"),
    )


def judge_int(reply: Column) -> Column:
    """Whole-number reply of the binary judge; anything else is 0."""
    s = strip(text(reply))
    return F.coalesce(F.when(s.rlike(r"\A[+-]?\d+\z"), s.try_cast("int")), F.lit(0))


def detailed_result(reply: Column) -> Column:
    """Struct of a reply with nested detail scores.

    A reply without a usable score counts as failed: zeros.  Without details, or without an accuracy
    among them, the answer score is the total score.
    """
    return let(let(strip(text(reply)), _as_map), _detailed)


def _detailed(m: Column) -> Column:
    score = F.try_element_at(m, F.lit("score")).try_cast("double")
    details = F.try_element_at(m, F.lit("detailed_scores"))
    failed = score.isNull()

    def parts(d: Column) -> Column:
        part = lambda key: F.try_element_at(d, F.lit(key)).try_cast("double")
        zero = lambda c: F.when(failed, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
        why = F.coalesce(F.try_element_at(m, F.lit("explanation")), F.lit(""))
        sure = F.coalesce(F.try_element_at(m, F.lit("confidence")).try_cast("double"), F.lit(0.8))
        return F.struct(
            zero(score).alias("score"), zero(part("reasoning")).alias("thinking_score"),
            zero(F.coalesce(part("accuracy"), score)).alias("answer_score"),
            zero(part("format")).alias("format_score"),
            F.when(failed, F.lit("Judge model failed")).otherwise(why).alias("explanation"),
            zero(sure).alias("confidence"),
            F.lit("vllm_judge").alias("source"), F.lit("vllm_model").alias("validation_method"),
        )

    return let(_as_map(F.coalesce(details, F.lit(""))), parts)


def weighted_judge(fmt: Column, reasoning: Column, answer: Column, prompt_type: Column) -> Column:
    """Total of three judge parts; weights follow the prompt type."""
    total = lambda w: w[0] * fmt + w[1] * reasoning + w[2] * answer
    return F.when(prompt_type == "thinking", total(THINKING_WEIGHTS)).otherwise(total(NORMAL_WEIGHTS))


def standard_result(
    enhanced: Column, explanation: Column, prompt_type: Column, box: Column | None = None
) -> Column:
    """Enhanced result under the field names of the rule reward."""
    return F.struct(
        enhanced["answer_score"].alias("acc_reward"),
        enhanced["thinking_score"].alias("thinking_reward"),
        enhanced["score"].alias("reward"),
        enhanced["format_score"].alias("format_score"),
        (box if box is not None else F.lit(0.0)).alias("bbox_reward"),
        explanation.alias("explanation"),
        F.lit("enhanced_judge").alias("source"),
        enhanced["validation_method"].alias("validation_method"),
        prompt_type.alias("prompt_type"),
        enhanced["confidence"].alias("confidence"),
    )


def judge_result(score: Column, explanation: Column, box: Column, problem_type: Column) -> Column:
    """Judge score under the rule reward's names, with half the box reward for spatial tasks."""
    spatial = F.when(problem_type == "SPATIAL_REASONING", box * 0.5).otherwise(F.lit(0.0))
    return F.struct(
        score.alias("reward"), score.alias("acc_reward"), spatial.alias("bbox_reward"),
        explanation.alias("explanation"), F.lit("judge").alias("source"),
    )

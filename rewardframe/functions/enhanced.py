"""Two-part scoring of thinking and answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import layered_answer, thinking_part
from .maths import math_equal
from .text import count_of, last_match, let, strip, strip_chars, text, words

# Signal words, ignored prompt words, weights (format, thinking, answer).
LOGIC_SIGNALS = (
    "首先", "第一步", "step 1", "first", "然后", "接着", "其次", "next", "最后", "因此", "所以", "finally",
)
MATH_SIGNALS = ("计算", "推导", "verify", "check", "因为", "since", "所以", "therefore")
IGNORED_WORDS = ("the", "a", "is", "what", "how")
THINKING_WEIGHTS = (0.10, 0.35, 0.55)
NORMAL_WEIGHTS = (0.05, 0.15, 0.80)
NORMAL_FORMAT, NORMAL_THINKING = 0.8, 0.7
NUMERIC_TYPES = ("MATH_EXPRESSIONS", "NUMBER")


def _hits(low: Column, signals: tuple[str, ...]) -> Column:
    n = F.lit(0)
    for s in signals:
        n = n + low.contains(s).cast("int")
    return n


def thinking_quality(thinking: Column, prompt: Column) -> Column:
    """Struct of length, logic, relevance, reasoning and their weighted overall score."""
    return let(
        F.struct(text(thinking).alias("thinking"), F.lower(text(thinking)).alias("low"), text(prompt).alias("prompt")),
        lambda x: _quality(x["thinking"], x["low"], x["prompt"]),
    )


def _quality(thinking: Column, low: Column, prompt: Column) -> Column:
    n = F.size(words(thinking))
    length = F.when(n < 20, 0.3).when(n < 100, 0.8).when(n < 200, 1.0).otherwise(0.9)
    logic = F.least(_hits(low, LOGIC_SIGNALS) / 3, F.lit(1.0))
    keys = F.array_except(
        F.array_distinct(words(F.lower(prompt))), F.array(*[F.lit(w) for w in IGNORED_WORDS])
    )
    relevance = let(keys, lambda k: F.size(F.filter(k, lambda w: F.contains(low, w)))
                    / F.greatest(F.size(k), F.lit(1)))
    reasoning = F.least(_hits(low, MATH_SIGNALS) / 2, F.lit(1.0))
    enough = F.length(strip(thinking)) >= 10
    parts = F.struct(*[
        F.when(enough, part).otherwise(F.lit(0.0)).alias(name)
        for name, part in (
            ("length", length), ("logic", logic), ("relevance", relevance), ("reasoning", reasoning),
        )
    ])

    def with_total(p: Column) -> Column:
        total = p["length"] * 0.2 + p["logic"] * 0.3 + p["relevance"] * 0.3 + p["reasoning"] * 0.2
        return F.struct(total.alias("overall"), *[p[n].alias(n) for n in ("length", "logic", "relevance", "reasoning")])

    return let(parts, with_total)


def thinking_summary(thinking: Column) -> Column:
    """Display form: the first hundred characters of a longer text."""
    return F.when(
        F.length(thinking) > 100, F.concat(F.substring(thinking, 1, 100), F.lit("..."))
    ).otherwise(thinking)


def normal_choice(c: Column) -> Column:
    """Choice letter of a short answer: a lone letter, else the first letter used exactly once."""

    def letter(t: Column) -> Column:
        lone = F.when(t.rlike(r"\A[A-Ha-h]\z"), F.upper(t))
        return F.coalesce(lone, *[F.when(count_of(t, x) == 1, F.lit(x)) for x in "ABCDEFGH"])

    return let(strip_chars(strip(text(c)), ".,!?;:"), letter)


def answer_check(pred: Column, gold: Column, answer_type: Column) -> Column:
    """Struct (correct, method, confidence) from the first check that accepts the answer."""
    return let(
        F.struct(text(pred).alias("p"), text(gold).alias("g")),
        lambda x: let(_accepting_check(x["p"], x["g"], answer_type), _with_confidence),
    )


def _accepting_check(pred: Column, gold: Column, answer_type: Column) -> Column:
    low_p, low_g = F.lower(pred), F.lower(gold)
    numeric = answer_type.isin(*NUMERIC_TYPES)
    num = lambda c: last_match(c, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return (
        F.when(F.lower(strip(pred)) == F.lower(strip(gold)), F.lit("exact_match"))
        .when(numeric & math_equal(pred, gold), F.lit("math_verify"))
        .when((answer_type == "MULTIPLE_CHOICE") & (normal_choice(pred) == normal_choice(gold)), F.lit("choice_match"))
        .when(F.contains(low_p, low_g) & (F.length(gold) > 1), F.lit("contained"))
        .when(numeric & (F.abs(num(pred) - num(gold)) < 1e-6), F.lit("numerical"))
        .otherwise(F.lit("all_failed"))
    )


def _with_confidence(method: Column) -> Column:
    confidence = (
        F.when(method == "exact_match", 1.0).when(method == "math_verify", 0.95)
        .when(method == "choice_match", 0.9).when(method == "contained", 0.7)
        .when(method == "numerical", 0.8).otherwise(0.0)
    )
    return F.struct(
        (method != "all_failed").alias("correct"), method.alias("method"), confidence.alias("confidence")
    )


def _by_type(prompt_type: Column, thinking, normal) -> Column:
    return F.when(prompt_type == "thinking", thinking).otherwise(normal)


def enhanced_parts(completion: Column) -> tuple[Column, Column]:
    """(thinking, answer) of a completion."""
    return thinking_part(completion), layered_answer(completion)


def enhanced_score(
    thinking: Column, predicted: Column, prompt: Column, gold: Column,
    prompt_type: Column, answer_type: Column,
) -> Column:
    """Struct with the weighted total and its parts; weights follow the prompt type."""
    fmt = _by_type(
        prompt_type,
        F.when(thinking.isNotNull(), 1.0).otherwise(0.0),
        F.when(predicted != "", NORMAL_FORMAT).otherwise(0.0),
    )
    think = _by_type(prompt_type, thinking_quality(thinking, prompt)["overall"], F.lit(NORMAL_THINKING))
    parts = F.struct(
        fmt.alias("fmt"), think.alias("think"), answer_check(predicted, gold, answer_type).alias("check")
    )
    wf, wt, wa = (_by_type(prompt_type, F.lit(a), F.lit(b)) for a, b in zip(THINKING_WEIGHTS, NORMAL_WEIGHTS))

    def total(x: Column) -> Column:
        ans = F.when(x["check"]["correct"], 1.0).otherwise(0.0)
        return F.struct(
            (wf * x["fmt"] + wt * x["think"] + wa * ans).alias("score"), x["fmt"].alias("format_score"),
            x["think"].alias("thinking_score"), ans.alias("answer_score"),
            x["check"]["method"].alias("validation_method"), x["check"]["confidence"].alias("confidence"),
        )

    return let(parts, total)


def score_explanation(result: Column, predicted: Column, gold: Column, prompt_type: Column) -> Column:
    """Human-readable account of an enhanced score."""
    pct = lambda i: _by_type(
        prompt_type, F.lit(f"{THINKING_WEIGHTS[i] * 100:.0f}"), F.lit(f"{NORMAL_WEIGHTS[i] * 100:.0f}")
    )
    num = lambda f, d: F.format_string(f"%.{d}f", result[f])
    return strip(F.concat(
        F.lit("评分详情 (类型: "), prompt_type, F.lit("):\n- 格式分 ("), pct(0), F.lit("%): "),
        num("format_score", 2), F.lit("\n  * "), _by_type(prompt_type, F.lit("使用"), F.lit("不使用")),
        F.lit("思考标签\n- 思考分 ("), pct(1), F.lit("%): "), num("thinking_score", 2),
        F.lit("\n- 答案分 ("), pct(2), F.lit("%): "), num("answer_score", 2),
        F.lit("\n  * 验证方法: "), result["validation_method"], F.lit("\n- 总分: "), num("score", 3),
        F.lit('\n\n预测答案: "'), predicted, F.lit('"\n标准答案: "'), gold, F.lit('"'),
    ))

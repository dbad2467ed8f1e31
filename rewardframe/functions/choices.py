"""Multiple-choice letter parsing and relaxed answer matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import all_matches, first_match, let, strip, strip_chars, text

# Letters, stripped punctuation (in this order), answer phrases.
CHOICES = "ABCDEFGH"
PUNCTUATION = (",", ".", "!", "?", ";", ":", "'", '"')
ANSWER_PHRASES = (
    "the answer is", "answer is", "the correct answer is", "correct answer is",
    "the answer", "answer", "correct answer", "the correct answer",
    "the best answer is", "best answer is", "the best answer", "best answer",
    "the option is", "option is", "the correct option is", "correct option is",
    "the choice is", "choice is", "the correct choice is", "correct choice is",
    "i choose", "i select", "i pick", "my answer is", "my choice is",
)
# Letter decorations from the most to the least trusted; the last but one tier shares one rank, the
# last takes any letter.
DECORATED = (r"\([A-H]\)", r"[A-H]\.", "[A-H]:", r"[A-H]\)", "[A-H] ", "[A-H][-_=]", "[A-H]")
NUMBERED = r"1\. A|2\. B|3\. C|4\. D|5\. E|6\. F|7\. G|8\. H"


def _earliest(response: Column, pattern: str) -> Column:
    """Letter of the distinct match whose last sighting lies furthest left; null without a match."""

    def pick(found: Column) -> Column:
        last = lambda x: F.struct(
            (F.size(found) - F.array_position(F.reverse(found), x)).alias("at"), x.alias("match")
        )
        return F.array_min(F.transform(F.array_distinct(found), last))["match"]

    match = let(all_matches(response, pattern), pick)
    return F.nullif(F.regexp_extract(match, "[A-H]", 0), F.lit(""))


def choice_letter(c: Column) -> Column:
    """Choice letter A-H named by a free-form answer; empty string when there is none.

    Tiers, best first: opening letter, closing letter, "1. A" numbering, first letter after an
    answer phrase, then decorated letters, then any letter at all.
    """
    response = strip(text(c))
    for p in PUNCTUATION:
        response = strip_chars(response, p)
    return let(F.concat(F.lit(" "), response, F.lit(" ")), _best_letter)


def _best_letter(padded: Column) -> Column:
    core = strip(padded)
    opening = first_match(core, f"\\A([{CHOICES}])")
    closing = first_match(core, f"([{CHOICES}])\\z")
    numbered = _earliest(padded, NUMBERED)
    phrase = "|".join(ANSWER_PHRASES)
    low = F.lower(padded)
    phrase_at = F.regexp_instr(low, F.lit(phrase))
    phrased = F.when(
        low.rlike(phrase),
        first_match(F.substring(padded, phrase_at, F.length(padded)), f"[{CHOICES}]", 0),
    )
    decorated = [_earliest(padded, pattern) for pattern in DECORATED]
    return F.when(
        core.rlike(f"[{CHOICES}]"),
        F.coalesce(opening, closing, numbered, phrased, *decorated, F.lit("")),
    ).otherwise("")


def relaxed_match(pred: Column, gold: Column, portion: float = 0.9) -> Column:
    """1.0 for an equal choice letter, near-complete containment either way, or trimmed equality."""
    pred, gold = text(pred), text(gold)
    n_pred, n_gold = F.length(pred), F.length(gold)
    near = (
        (gold.contains(pred) & (n_pred >= portion * n_gold))
        | (pred.contains(gold) & (n_gold >= portion * n_pred))
        | (strip(pred) == strip(gold))
    )
    return F.when(
        gold.isin(*CHOICES), F.when(choice_letter(pred) == gold, 1.0).otherwise(0.0)
    ).otherwise(F.when(near, 1.0).otherwise(0.0))

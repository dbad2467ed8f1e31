"""Rule rewards. Each takes the extracted last answer (null when absent) and the gold answer.

Extract once with :func:`rewardframe.functions.extract.last_answer` and hand the column to as many
rules as needed, so that the tag search runs once per completion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import all_matches, both, collapse, flag, has_any, last_match, let, strip, strip_chars, text

# Number and box patterns.
NUMBER_RUN = r"[0-9.]+"
_NUM = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
BOX = r"\[\s*" + _NUM + r"(?:\s*,\s*" + _NUM + r")*\s*\]"


def number_match(pred: Column, gold: Column) -> Column:
    """Last digit run of the answer equals the trimmed gold text."""
    run = F.coalesce(last_match(text(pred), NUMBER_RUN, 0), F.lit(""))
    return flag(run == strip(gold))


def string_match(pred: Column, gold: Column) -> Column:
    """Trimmed, case-insensitive equality; an empty answer never matches."""
    return flag((pred != "") & (F.lower(strip(pred)) == F.lower(strip(gold))))


def _truth(c: Column) -> Column:
    low = F.lower(c)
    return F.when(has_any(low, ("yes", "true")), True).when(has_any(low, ("no", "false")), False)


def truth_match(pred: Column, made: Column, ref: Column) -> Column:
    """As :func:`bool_match`, given columns of the lower-cased texts."""
    yes, no = ("yes", "true"), ("no", "false")
    same = F.when(has_any(made, yes), has_any(ref, yes)).when(has_any(made, no), ~has_any(ref, yes) & has_any(ref, no))
    return flag((pred != "") & same)


def bool_match(pred: Column, gold: Column) -> Column:
    """Equality of the truth values read from substrings; yes/true is tested before no/false."""
    return flag((pred != "") & (_truth(pred) == _truth(gold)))


def choice_match(pred: Column, gold: Column) -> Column:
    """First character of the answer, punctuation stripped, equals the gold letter."""
    letter = F.upper(F.substring(strip_chars(strip(pred), ".()"), 1, 1))
    return flag((pred != "") & (letter == F.upper(gold)))


def exact_match(pred: Column, gold: Column) -> Column:
    return flag(strip(pred) == strip(gold))


def ocr_match(pred: Column, targets: Column) -> Column:
    """One minus the smallest normalised edit distance to a target; below one half counts zero."""


    def nearest(seen: Column) -> Column:
        def distance(target: Column) -> Column:
            longest = F.greatest(F.length(F.upper(target)), F.length(F.upper(seen)))
            steps = let(
                collapse(F.lower(strip(target))),
                lambda x: F.when(x == seen, F.lit(0)).otherwise(F.levenshtein(x, seen)),
            )
            return F.when(longest == 0, F.lit(0.0)).otherwise(steps / longest)

        return 1 - F.array_min(F.transform(targets, distance))

    score = let(let(collapse(F.lower(strip(pred))), nearest), lambda s: F.when(s >= 0.5, s))
    return F.coalesce(F.when(pred != "", score), F.lit(0.0))


def nearness(pred: Column, seen: Column, ref: Column, target: Column) -> Column:
    """As :func:`ocr_match` of one target, given columns of the collapsed lower-cased answer and target."""
    longest = F.greatest(F.length(F.upper(target)), F.length(F.upper(seen)))
    steps = F.when(ref == seen, F.lit(0)).otherwise(F.levenshtein(ref, seen))
    near = 1 - F.when(longest == 0, F.lit(0.0)).otherwise(steps / longest)
    return F.coalesce(F.when(pred != "", let(near, lambda s: F.when(s >= 0.5, s))), F.lit(0.0))


def first_box(c: Column) -> Column:
    """First bracketed number list as doubles; null when there is none."""
    # A match is never empty, and the blanks it may hold beside its numbers are such as the cast passes over.
    body = strip_chars(F.nullif(F.regexp_extract(text(c), BOX, 0), F.lit("")), "[]")
    return F.transform(F.split(body, ","), lambda x: x.try_cast("double"))


def box_iou(pred: Column, gold: Column) -> Column:
    """Intersection over union of two four-number boxes; zero area or a bad box gives 0.0."""
    zero = F.lit(0.0)

    def iou(boxes: Column) -> Column:
        a, b = F.get(boxes, F.lit(0)), F.get(boxes, F.lit(1))
        width = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
        height = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
        both = width * height
        areas = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1])
        ratio = F.coalesce(F.try_divide(both, areas - both), zero)
        return F.when((F.size(a) == 4) & (F.size(b) == 4), ratio).otherwise(zero)

    # The number patterns are searched only where both texts open a bracket.
    return F.when(pred.contains("[") & gold.contains("["), let(both(pred, gold, first_box), iou)).otherwise(zero)


def numbers_in(c: Column) -> Column:
    """Every number of the text as a double, thousands commas removed first."""
    found = all_matches(
        F.replace(text(c), F.lit(","), F.lit("")),
        r"[+-]? *(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?",
    )

    # Leading blanks and zeros go; what is left must still be a number: "0" alone is not, and a
    # signed integer may not start with a zero.
    bare = F.transform(found, lambda x: F.replace(F.ltrim(F.btrim(x), F.lit(" 0")), F.lit(" "), F.lit("")))
    values = F.transform(
        bare, lambda b: F.when(~b.rlike(r"\A[+-]0+[1-9]\d*\z"), b.try_cast("double"))
    )
    return F.filter(values, lambda v: v.isNotNull())

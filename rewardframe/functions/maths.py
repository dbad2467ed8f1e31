"""LaTeX clean-up and numeric answer equality.

Numbers, fractions, and tuples or lists of them compare by value rounded to two decimals; symbolic
algebra is not attempted, and ``math_method`` names the rule that matched so gaps stay visible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import last_answer
from .text import (
    WHITESPACE, WS, all_matches, both, count_of, find, first_match, flag, let, lstrip, rstrip, strip,
    strip_read, swap, text,
)

# Literal replacements in the order they apply, and the lead-in patterns of answers.
FIRST_CLEANUP = (
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""),
    ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("$", ""),
)
DECIMAL_CLEANUP = (("\\%", ""), (" .", " 0."), ("{.", "{0."))
ANSWER_CLEANUP = (
    (" ", ""), ("\\,", ""), ("∞", "\\infty"), ("+\\infty", "\\infty"), ("\\\\", "\\"), ("\n", ""),
    ("\\text", ""), ("\\mbox", ""), ("bmatrix", "pmatrix"), ("\\left", ""), ("\\right", ""),
    ("^{\\circ}", ""), ("^\\circ", ""), ("{m}^3", ""), ("m^3", ""), ("{units}", ""), ("units", ""),
    ("{km}", ""), ("km", ""),
)
OPTION_ENDS = (
    r" ([A-Za-z])\.\z", r" \(([A-Za-z])\)\.\z", r" \(([A-Za-z])\)\z", r"\*\*([A-Za-z])\*\*\.\z",
)
OPTION_STARTS = (r"\A([A-Za-z])\n", r"\A\(([A-Za-z])\)\n", r"\A\(([A-Za-z])\) \1\n")
NAMED_OPTION = (r"\(([A-Za-z])\)", r"\{([A-Za-z])\}", r"([A-Z])\. ", r"\A([A-Za-z])\) ")
_LINK = r"(?:(?:\s+(?:is|should be))|(?:\:))?"
_REST = _LINK + r"(?:\*\*)?" + _LINK + r"(?:\s+)?\n?"
_END = r"(?:\n|$|\.(?:\s|$))"
LEAD_INS = (
    (r"Answer(?:\:?)\*\*(?:\:?)(?:\s+)?\n?", r"(?:\n|$|\.\s)"),
    (r"(?:f|F)inal\s+(?:a|A)nswer" + _REST, _END),
    (r"(?:c|C)orrect\s+(?:a|A)nswer" + _REST, _END),
    (r"(?:t|T)he\s+(?:a|A)nswer" + _REST, _END),
)
_PARTS_OF_LEAD_INS = ("Answer", "inal", "orrect", "he")  # every match of the lead-in holds it
_CANDIDATES = "array<struct<far:int,rank:int,body:string>>"
PLAIN_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?"
ANY_NUMBER = r"(?i)\A[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+)?|inf|infinity|nan)\z"


def _replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda acc, p: swap(acc, *p), pairs, c)


def _after_only(c: Column, mark: str) -> Column:
    """What follows the mark when it occurs exactly once, else the text itself."""
    return let(c, lambda s: F.when(count_of(s, mark) == 1, F.substring_index(s, mark, -1)).otherwise(s))


def _braced_fractions(c: Column) -> Column:
    r"""``\frac12`` as ``\frac{1}{2}``; left alone when any fraction lacks two characters."""

    def fix(p: Column) -> Column:
        a, b, more = F.substring(p, 1, 1), F.substring(p, 2, 1), F.substring(p, F.lit(3), F.length(p))
        top = F.concat(F.lit("{"), a, F.lit("}"))
        low = F.when(b == "{", b).otherwise(F.concat(F.lit("{"), b, F.lit("}")))
        return F.when(p.startswith("{"), p).otherwise(F.concat(top, low, more))

    def whole(parts: Column) -> Column:
        rest = F.slice(parts, F.lit(2), F.size(parts))
        short = F.exists(rest, lambda p: ~p.startswith("{") & (F.length(p) < 2))
        done = F.when(short, rest).otherwise(F.transform(rest, fix))
        return F.array_join(F.concat(F.slice(parts, 1, 1), done), "\\frac")

    return let(F.split(c, r"\\frac"), whole)


def latex_normal(c: Column) -> Column:
    """Canonical spelling of a LaTeX answer.

    Bare fractions get braces only in texts that hold a square root, as the scoring rules expect.
    """
    s = _replaced(text(c), FIRST_CLEANUP)
    s = _replaced(F.substring_index(s, "\\text{ ", 1), DECIMAL_CLEANUP)
    s = F.regexp_replace(s, r"\A\.", "0.")
    s = _after_only(_after_only(s, "="), "\\approx")
    s = F.regexp_replace(s, r"(?s)\\sqrt(?!\{|\\sqrt)(.)", r"\\sqrt{$1}")
    s = swap(s, " ", "")
    s = let(s, lambda x: F.when(x.contains("sqrt"), _braced_fractions(x)).otherwise(x))
    s = F.regexp_replace(s, r"\A0\.5\z", r"\\frac{1}{2}")
    whole = r"(0|-?[1-9]\d*)"
    return F.regexp_replace(s, r"\A" + whole + "/" + whole + r"\z", r"\\frac{$1}{$2}")


def math_answer(c: Column) -> Column:
    """Boxed or bare answer, right of the last equals sign, units removed, LaTeX normalised."""
    s = swap(F.lower(text(c)), "{}", "")
    s = let(s, lambda x: F.coalesce(F.when(x.contains("oxed{"), first_match(x, r"(?s)oxed\{(.*)\}")), x))
    # A closing brace before any opening one ends the answer.
    s = F.regexp_replace(s, r"(?s)\A([^{}]*)\}.*\z", "$1")
    s = F.substring_index(F.substring_index(s, "=", -1), "\\approx", -1)
    return latex_normal(_replaced(s, ANSWER_CLEANUP))


def strict_answer(c: Column) -> Column:
    """Last answer body with an "(A)" wrapping removed; empty when there is no tag."""
    return unwrapped(F.coalesce(last_answer(text(c)), F.lit("")))


def unwrapped(body: Column) -> Column:
    """The answer body with an "(A)" wrapping removed."""
    inner = strip(F.substring(body, F.lit(2), F.length(body) - 2))
    wrapped = body.contains("(") & body.rlike(r"\A" + WS + r"*\([a-zA-Z]\)")
    return F.when(wrapped, inner).otherwise(body)


def _tidy(c: Column) -> Column:
    c = F.regexp_replace(c, r"\Aoption", "")
    return strip(F.regexp_replace(c, r"(?s)\A\*\*(.*)\*\*\z", "$1"))


def _lead_in_candidates(t: Column, rank: int, lead: str, end: str) -> Column:
    """Candidates after one lead-in pattern, each with its distance to the end of the text."""
    pattern = f"(?d)({lead})(.*?){end}"
    start = F.struct(F.lit(1).alias("at"), F.array().cast(_CANDIDATES).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        at = F.position(m, t, acc["at"])
        far = F.length(t) - (at + F.length(F.regexp_extract(m, pattern, 1)) - 1)
        item = F.struct(
            far.cast("int").alias("far"), F.lit(rank).alias("rank"),
            _tidy(strip(F.regexp_extract(m, pattern, 2))).alias("body"),
        )
        return F.struct(
            (at + F.length(m)).alias("at"), F.concat(acc["out"], F.array(item)).alias("out")
        )

    return F.aggregate(all_matches(t, pattern, 0), start, step, lambda acc: acc["out"])


def lenient_answer(c: Column) -> Column:
    """Strict answer, else the candidate nearest to the end of the text, normalised."""
    searched = let(strip(text(c)), _nearest_answer)
    return let(
        strict_answer(c), lambda s: F.when(s != "", s).otherwise(F.coalesce(searched, F.lit("")))
    )


def _nearest_answer(t: Column) -> Column:
    def item(body: Column, rank: int) -> Column:
        return F.struct(F.lit(0).alias("far"), F.lit(rank).alias("rank"), body.alias("body"))

    # Options are named within the first or the last six characters.
    head, end = F.substring(t, 1, 6), F.substring(t, -6, 6)
    listed = F.array(*[first_match(end, p) for p in OPTION_ENDS], *[first_match(head, p) for p in OPTION_STARTS])
    chosen = F.when(t.endswith(".") | t.endswith(")") | head.contains("\n"), F.array_min(listed))
    tail = rstrip(strip(F.substring_index(t, "is", -1)), ".")
    tail = strip(F.regexp_replace(tail, r"\Athe ", ""))
    tail = strip(F.regexp_replace(tail, r"\A:", ""))
    ending = let(tail, lambda x: F.when(x.rlike(ANY_NUMBER) | x.rlike(r"\A[A-Z]\z"), x))

    sure = F.array(item(_tidy(chosen), 0), item(_tidy(ending), 1))
    led = F.concat(*[
        F.when(t.contains(part), _lead_in_candidates(t, i + 2, lead, stop)).otherwise(F.array().cast(_CANDIDATES))
        for i, ((lead, stop), part) in enumerate(zip(LEAD_INS, _PARTS_OF_LEAD_INS, strict=True))
    ])
    pool = F.when(t.contains("nswer"), F.concat(sure, led)).otherwise(sure)
    best = F.array_min(F.filter(pool, lambda x: x["body"] != ""))["body"]

    def letter_or_all(answer: Column) -> Column:
        named = F.concat(*[all_matches(answer, p, 1) for p in NAMED_OPTION])
        may = answer.contains("(") | answer.contains("{") | answer.contains(". ") | answer.contains(") ")
        return F.when(may, F.coalesce(F.array_min(named), answer)).otherwise(answer)

    # Null when no candidate was found, and null through every step below.
    pick = let(best, letter_or_all)
    out = F.when(pick.isNotNull(), math_answer(pick))
    out = F.regexp_replace(out, r"\(([A-Za-z])\)", "$1")
    out = F.regexp_replace(out, r"\{([A-Za-z])\}", "$1")
    return lstrip(rstrip(out, WHITESPACE + "."), WHITESPACE + ":")


def numeric_value(c: Column) -> Column:
    r"""Double of a number, ``a/b`` or ``\frac{a}{b}``; null for anything else."""
    s = _replaced(F.lower(text(c)), (("$", ""), (" ", ""), ("dfrac", "frac"), ("tfrac", "frac")))
    return let(s, _ratio_or_number)


def _ratio_or_number(s: Column) -> Column:
    plain = r"\A" + PLAIN_NUMBER + r"\z"
    ratio = r"\A(" + PLAIN_NUMBER + ")/(" + PLAIN_NUMBER + r")\z"
    frac = r"\A([+-]?)\\frac\{(" + PLAIN_NUMBER + r")\}\{(" + PLAIN_NUMBER + r")\}\z"
    num = lambda p, g: F.regexp_extract(s, p, g).try_cast("double")
    sign = F.when(F.regexp_extract(s, frac, 1) == "-", -1.0).otherwise(1.0)
    return (
        F.when(s.rlike(plain), s.try_cast("double"))
        .when(s.contains("/") & s.rlike(ratio), F.try_divide(num(ratio, 1), num(ratio, 2)))
        .when(s.contains("\\frac{") & s.rlike(frac), sign * F.try_divide(num(frac, 2), num(frac, 3)))
    )


def _bracketed(c: Column) -> Column:
    return (c.startswith("(") & c.endswith(")")) | (c.startswith("[") & c.endswith("]"))


def _may_be_number(c: Column) -> Column:
    """Whether the text begins as a number, a fraction or an amount does: with a character up to the digits, or a backslash."""
    return (c < ":") | c.startswith("\\")


def rounded_tuple(c: Column) -> Column:
    """Tuple or list with every element rounded to two decimals; other texts unchanged."""


    def value(x: Column) -> Column:
        keep = x.contains("infty") | x.isin("a", "-a")
        return F.when(keep, x).otherwise(F.round(numeric_value(x), 2).cast("string"))

    def whole(vals: Column) -> Column:
        known = (F.size(vals) > 1) & ~F.exists(vals, lambda v: v.isNull())
        return F.when(
            known, F.concat(F.substring(c, 1, 1), F.array_join(vals, ","), F.substring(c, -1, 1))
        ).otherwise(c)

    items = F.split(F.substring(c, F.lit(2), F.length(c) - 2), ",")
    return F.when(_bracketed(c), let(F.transform(items, value), whole)).otherwise(c)


def math_method(pred: Column, gold: Column) -> Column:
    """Name of the rule by which two answers agree: text, tuple, numeric; else none.

    Texts that are not equal agree as tuples only where both have brackets, as numbers only where both begin as numbers.
    """

    return let(both(text(pred), text(gold), F.lower), lambda pair: method_of(F.get(pair, F.lit(0)), F.get(pair, F.lit(1))))


def method_of(a: Column, b: Column) -> Column:
    """As :func:`math_method`, given the lower-cased texts as columns that are only read."""

    def agree(use) -> Column:
        return let(both(a, b, use), lambda v: F.get(v, F.lit(0)) == F.get(v, F.lit(1)))

    return (
        F.when((F.trim(a) == "") | (F.trim(b) == ""), F.lit("none"))
        .when((a == b) | (strip_read(a) == strip_read(b)), F.lit("text"))
        .when(_bracketed(a) & _bracketed(b) & agree(rounded_tuple), F.lit("tuple"))
        .when(_may_be_number(a) & _may_be_number(b) & agree(lambda x: F.round(numeric_value(x), 2)), F.lit("numeric"))
        .otherwise(F.lit("none"))
    )


def math_equal(pred: Column, gold: Column) -> Column:
    return math_method(pred, gold) != "none"


def math_match(completion: Column, gold: Column) -> Column:
    """Math reward: the strict answer equals the gold answer."""
    return flag(math_equal(strict_answer(completion), gold))


def without_extra_zeros(c: Column) -> Column:
    """Number text without trailing zeros ("3.10" as "3.1", "5.0" as "5"); other text unchanged."""
    plain = F.rtrim(F.rtrim(c.try_cast("double").try_cast("decimal(38,18)").cast("string"), F.lit("0")), F.lit("."))
    return F.coalesce(plain, c)


def formula(c: Column) -> Column:
    """Body of the only ``<<...>>`` formula; null unless both marks occur exactly once."""
    one = (count_of(c, "<<") == 1) & (count_of(c, ">>") == 1)
    start = find(c, "<<") + 2
    return F.when(one, F.substring(c, start, F.greatest(find(c, ">>") - start, F.lit(0))))


def in_area(sample_id: Column, area: str) -> Column:
    """Whether a sample id names the subject area as a folder or a test file."""
    if area == "all":
        return F.lit(True)
    return sample_id.contains(f"/{area}/") | sample_id.contains(f"{area}_test.csv")

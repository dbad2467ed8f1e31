"""Format rewards. Ordered-tag checks are position chains, linear in the text, not regex backtracking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import BOXED_OPEN, THINK_TAG, answer_bodies, boxed_answer, tagged_answer
from .text import WS, all_matches, count_of, find, first_match, flag, strip, swap, text

# Tags counted by the tag reward, the box in a think block, and the strict pairs.
COUNTED_TAGS = ("<think>", "</think>", "<answer>", "</answer>")
FOUR_NUMBERS = (
    r"\[\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*\]"
)
MATH_SIGN = r"[=+\-*/()\[\]\\]"
REASONING_BODY = r"(?is)<reasoning>(.*?)</reasoning>"
ANSWER_BODY = r"(?is)<answer>(.*?)</answer>"
OPEN_REASONING = r"(?i)<reasoning\b[^>]*>"
OPEN_ANSWER = r"(?i)<answer\b[^>]*>"
ANY_TAG = r"(?i)</?" + WS + r"*(?:reasoning|answer)\b"


def _ends(c: Column, first: str, last: str) -> Column:
    """Starts and ends with two literals that do not overlap."""
    return c.startswith(first) & c.endswith(last) & (F.length(c) >= len(first) + len(last))


def _in_order(c: Column, *tags: str) -> Column:
    """The literals occur one after another."""
    at = find(c, tags[0])
    ok = at > 0
    for prev, tag in zip(tags, tags[1:]):
        at = find(c, tag, F.greatest(at, F.lit(1)) + len(prev))
        ok = ok & (at > 0)
    return ok


def think_answer_format(c: Column) -> Column:
    """Whole text is a think block, anything, and an answer block."""
    inner = F.substring(c, F.lit(8), F.length(c) - 16)
    return _ends(c, "<think>", "</answer>") & _in_order(inner, "</think>", "<answer>")


def format_score(c: Column, tagged: Column | None = None) -> Column:
    """1.0 for think+answer or boxed content, 0.8 for a long text with math and an answer, else 0.

    ``tagged`` is the extracted answer where a caller has it already.
    """
    c = text(c)
    tagged = tagged_answer(c) if tagged is None else tagged
    partial = (
        (F.length(strip(c)) > 50) & c.rlike(MATH_SIGN) & (tagged != "")
    )
    return (
        F.when(think_answer_format(c) | (boxed_answer(c) != ""), F.lit(1.0))
        .when(partial, F.lit(0.8))
        .otherwise(F.lit(0.0))
    )


def boxed_format(c: Column) -> Column:
    """One think pair followed by boxed content, answer tags at most a fifth of the text."""
    c = text(c)
    bodies = answer_bodies(c)
    tag_chars = F.when(c.contains("</answer>"), F.length(F.array_join(bodies, "")) + 9 * F.size(bodies)).otherwise(0)
    ok = (
        c.contains(BOXED_OPEN)
        & _in_order(c, "<think>", "</think>", BOXED_OPEN, "}")
        & (count_of(c, "<think>") == 1)
        & (count_of(c, "</think>") == 1)
        & (F.try_divide(tag_chars, F.length(c)) <= 0.2)
    )
    return flag(ok)


def think_has_box(c: Column) -> Column:
    """Some think block holds a bracketed list of four numbers."""
    c = text(c)
    may = c.contains("</think>") & c.contains("[")  # otherwise no block needs to be cut out
    return flag(F.when(may, F.exists(all_matches(c, THINK_TAG, 1), lambda b: b.rlike(FOUR_NUMBERS))))


def xml_format(c: Column) -> Column:
    """Only a think block and an answer block with blanks around them, or :func:`boxed_format`."""
    s = text(c)
    # Only blanks before the first think tag and after the last answer tag; the pattern can't reach into either.
    alone = (strip(F.substring_index(s, "<think>", 1)) == "") & (strip(F.substring_index(s, "</answer>", -1)) == "")
    strict = (
        s.contains("<think>") & s.contains("</answer>") & s.contains("</think>") & alone
        & (s.contains("</think><answer>") | s.rlike("</think>" + WS + "*<answer>"))
    )
    return F.greatest(flag(strict), boxed_format(s))


def tag_count_score(c: Column) -> Column:
    """A quarter for each tag that occurs exactly once."""
    c = text(c)
    score = F.lit(0.0)
    for tag in COUNTED_TAGS:
        score = score + F.when(count_of(c, tag) == 1, 0.25).otherwise(0.0)
    return score


def anchored_format(c: Column) -> Column:
    """Trimmed text is exactly one reasoning block and one answer block, any letter case."""
    low = F.lower(strip(text(c)))
    inner = F.substring(low, F.lit(12), F.length(low) - 20)
    return flag(
        _ends(low, "<reasoning>", "</answer>") & inner.rlike("</reasoning>" + WS + "*<answer>")
    )


def strict_format(c: Column) -> Column:
    """Struct with the strict reasoning/answer reward and its diagnostics.

    Tags are looked for in the lower-cased text: no character outside ASCII becomes part of these tags there.  Patterns
    run only over texts with tags in other shapes than the plain ones.
    """
    c = text(c)
    low = F.lower(c)

    def opened(tag: str, pattern: str) -> Column:
        odd = swap(low, f"<{tag}>", "").contains(f"<{tag}")
        n = F.when(odd, F.regexp_count(c, F.lit(pattern)).cast("int")).otherwise(count_of(low, f"<{tag}>"))
        return F.when(low.contains(f"<{tag}"), n).otherwise(0)

    def closed(tag: str) -> Column:
        return F.when(low.contains(f"</{tag}>"), count_of(low, f"</{tag}>")).otherwise(0)

    def place(tag: str) -> tuple[Column, Column]:
        """Where the first pair's body begins and ends; the end is 0 without a pair."""
        start = F.when(low.contains(f"</{tag}>"), find(low, f"<{tag}>")).otherwise(0)
        return start + len(tag) + 2, F.when(start > 0, find(low, f"</{tag}>", start + len(tag) + 2)).otherwise(0)

    def body(tag: str) -> Column:
        start, end = place(tag)
        return F.substring(low, start, end - start)

    def filled(inner: Column) -> Column:
        return ((inner >= "!") & (inner < "\x7f")) | (strip(inner) != "")  # a visible first character is enough

    def free(found: Column, inner: Column, pattern: str) -> Column:
        """No tags inside; every tag begins with a bracket."""
        tags = F.coalesce(first_match(c, pattern).rlike(ANY_TAG), F.lit(False))
        return F.when(found & inner.contains("<"), ~tags).otherwise(True)

    open_r, close_r = opened("reasoning", OPEN_REASONING), closed("reasoning")
    open_a, close_a = opened("answer", OPEN_ANSWER), closed("answer")
    has_r, has_a = place("reasoning")[1] > 0, place("answer")[1] > 0
    single = (open_r == 1) & (close_r == 1) & (open_a == 1) & (close_a == 1) & has_r & has_a
    order = has_r & has_a & (place("reasoning")[0] - len("reasoning") < place("answer")[0] - len("answer"))
    r_full, a_full = has_r & filled(body("reasoning")), has_a & filled(body("answer"))
    clean = free(has_r, body("reasoning"), REASONING_BODY) & free(has_a, body("answer"), ANSWER_BODY)
    return F.struct(
        flag(single & order & r_full & a_full & clean).alias("reward"),
        has_r.alias("has_reasoning"), has_a.alias("has_answer"),
        open_r.alias("open_reasoning"), close_r.alias("close_reasoning"),
        open_a.alias("open_answer"), close_a.alias("close_answer"),
        single.alias("single_pair_ok"), order.alias("order_ok"),
        r_full.alias("reasoning_non_empty"), a_full.alias("answer_non_empty"),
        clean.alias("nested_ok"), F.length(c).alias("text_len"),
    )

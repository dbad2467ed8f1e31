"""Answer extraction from completions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import (
    WORD, WS, all_matches, find, first_match, first_of, has_any, last_of, let, lines, strip, swap, text, words,
)

# Patterns and phrases the extractors look for.
ANSWER_TAG = r"(?s)<answer>(.*?)</answer>"
ANSWER_OPEN, ANSWER_CLOSE = "<answer>", "</answer>"
_TO_THE_END = 2**31 - 1
THINK_TAG = r"(?s)<think>(.*?)</think>"
BOXED_OPEN = "\\boxed{"
_BOX_TOKEN = r"\\boxed\{|[{}]|[^{}\\]+|\\"
ANSWER_TAG_ANY_CASE = r"(?is)<answer>(.*?)</answer>"
ANSWER_PREFIXES = ("answer:", "the answer is:", "answer is:")
CHOICE_PHRASES = (
    "answer is", "答案是", "the answer", "正确答案是", "correct answer is", "选项", "choice is",
)
ASSIGNING_OPERATORS = ("+=", "-=", "*=", "/=", "==")
NO_REASONING = ("n/a", "na", "none", "无", "空")
NO_REASONING_TEXT = "（模型未给出有效推理内容）"
NO_ANSWER_TEXT = "（模型未给出有效答案内容）"
FORBIDDEN_CALLS = (
    "os.remove", "os.unlink", "os.rmdir", "os.rename", "os.replace", "shutil.", "pathlib", "path.",
    "open(", "os.system", "subprocess", "fopen(", "rm -", "rmtree", "shutil.move", "shutil.copy",
    ".unlink(", ".rmdir(", ".rename(",
)

_LAST_NUMBER = (
    r"(?<!" + WORD + r")(\d+(?:\.\d+)?)(?!" + WORD + r")" + WS + r"*\.?" + WS + r"*\z"
)
_LINE_ENDS_IN_DIGIT = r"\d" + WS + r"*\.?" + WS + r"*(?:\n|\z)"


def answer_bodies(c: Column) -> Column:
    """Every ``<answer>`` body, in order."""
    return all_matches(c, ANSWER_TAG, 1)


def before_last_close(c: Column) -> Column:
    """What lies between the last two closing answer tags (or the start and the only one); null without a closing tag."""
    return F.when(c.contains(ANSWER_CLOSE), F.substring_index(F.substring_index(c, ANSWER_CLOSE, -2), ANSWER_CLOSE, 1))


def last_answer_in(before: Column, c: Column) -> Column:
    """As :func:`last_answer`, given a column of :func:`before_last_close`."""
    start = find(before, ANSWER_OPEN) + len(ANSWER_OPEN)
    paired = F.when(before.contains(ANSWER_OPEN), F.substring(before, start, F.lit(_TO_THE_END)))
    return F.when(before.isNotNull(), F.coalesce(paired, last_of(answer_bodies(c))))


def last_answer(c: Column) -> Column:
    """The last ``<answer>`` body; null when the completion has none.

    It ends at the last closing tag where an opening one lies between that and the closing tag before; only otherwise
    are all bodies looked for.
    """
    before = F.substring_index(F.substring_index(c, ANSWER_CLOSE, -2), ANSWER_CLOSE, 1)
    paired = before.contains(ANSWER_OPEN) & c.contains(ANSWER_CLOSE)
    start = F.when(paired, find(before, ANSWER_OPEN) + len(ANSWER_OPEN))
    body = F.substring(before, start, F.lit(_TO_THE_END))  # null without a start
    return F.coalesce(body, F.when(c.contains(ANSWER_CLOSE), last_of(answer_bodies(c))))


def _last_closed(tokens: Column) -> Column:
    """1-based place of the last box that is closed, 0 for none.

    Read from the end: a closing brace waits for its opening one, so an opening one is closed exactly
    if one is waiting.
    """
    start = F.struct(F.lit(0).alias("waiting"), F.size(tokens).alias("at"), F.lit(0).alias("found"))

    def step(acc: Column, tok: Column) -> Column:
        opens = (tok == "{") | (tok == BOXED_OPEN)
        waiting = F.when(tok == "}", acc.waiting + 1).when(opens, F.greatest(acc.waiting - 1, F.lit(0))).otherwise(acc.waiting)
        found = F.when((acc.found == 0) & (tok == BOXED_OPEN) & (acc.waiting > 0), acc.at).otherwise(acc.found)
        return F.struct(waiting.alias("waiting"), (acc.at - 1).alias("at"), found.alias("found"))

    return F.aggregate(F.reverse(tokens), start, step)["found"]


def _closing(tokens: Column) -> Column:
    """Number of tokens before the brace that closes an already open one."""
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

    def step(acc: Column, tok: Column) -> Column:
        opens = (tok == "{") | (tok == BOXED_OPEN)
        depth = F.when(acc.depth == 0, 0).when(opens, acc.depth + 1).when(tok == "}", acc.depth - 1).otherwise(acc.depth)
        return F.struct(depth.alias("depth"), (acc.n + (depth > 0).cast("int")).alias("n"))

    return F.aggregate(tokens, start, step)["n"]


def boxed_answer(c: Column) -> Column:
    """Content of the last brace-balanced ``\\boxed{...}``; empty string when there is none.

    The last box is it where its first brace closes it.  Otherwise the text is cut into braces, boxes and
    what lies between once, and read twice.
    """
    after = F.substring_index(c, BOXED_OPEN, -1)
    plain = F.substring_index(after, "}", 1)

    def content(tokens: Column) -> Column:
        def tail(at: Column) -> Column:
            rest = F.slice(tokens, at + 1, F.size(tokens))
            body = let(rest, lambda r: F.array_join(F.slice(r, F.lit(1), _closing(r)), ""))
            return F.when(at > 0, body).otherwise("")

        return let(_last_closed(tokens), tail)

    nested = let(all_matches(c, _BOX_TOKEN), content)
    found = F.when(after.contains("}") & ~plain.contains("{"), plain).otherwise(nested)
    return F.when(c.contains(BOXED_OPEN), found).otherwise("")


def last_line_number(c: Column) -> Column:
    """Number that ends the lowest line ending in one; empty string when no line does."""
    ends = F.transform(lines(strip(c)), lambda ln: F.regexp_extract(ln, _LAST_NUMBER, 1))
    # Lines are cut only where one may end in a number.
    return F.coalesce(F.when(c.rlike(_LINE_ENDS_IN_DIGIT), last_of(F.filter(ends, lambda x: x != ""))), F.lit(""))


def tagged_answer(c: Column) -> Column:
    """First ``<answer>`` body (even an empty one), else boxed content, else a final number."""
    c = text(c)
    return F.coalesce(
        first_match(c, ANSWER_TAG), F.nullif(boxed_answer(c), F.lit("")), last_line_number(c)
    )


def plain_answer(c: Column) -> Column:
    """One final period dropped, then trimmed."""
    c = text(c)
    return strip(F.when(c.endswith("."), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c))


def answer_text(c: Column) -> Column:
    """Trimmed body of the first answer tag, any letter case; empty when absent."""
    return strip(F.regexp_extract(text(c), ANSWER_TAG_ANY_CASE, 1))


def python_block(c: Column) -> Column:
    """Code of a last answer: the first fenced python block, an unclosed one to the end, else all."""
    body = strip(c)
    closed = first_match(body, r"```python(?:\r?\n)?([\s\S]*?)```")
    opened = first_match(body, r"```python(?:\r?\n)?([\s\S]*)\z")
    return F.when(c.contains("```python"), strip(F.coalesce(closed, opened, body))).otherwise(body)


def forbidden_calls(code: Column) -> Column:
    """Distinct forbidden signatures found in the code, sorted."""
    low = F.lower(code)
    listed = F.array(*[F.lit(s) for s in FORBIDDEN_CALLS])
    return F.array_sort(F.filter(listed, lambda s: F.contains(low, s)))


def calls_forbidden(code: Column) -> Column:
    """Whether :func:`forbidden_calls` finds any."""
    return let(F.lower(code), lambda low: has_any(low, FORBIDDEN_CALLS))


def clean_generated(c: Column) -> Column:
    """Unix line ends, think tags dropped, runs of blank lines shortened, trimmed."""
    out = swap(text(c), "\r\n", "\n")
    out = F.regexp_replace(out, r"(?i)</?" + WS + "*think" + WS + "*>", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def reasoning_part(cleaned: Column) -> Column:
    """Text after the first ``Reasoning:`` label up to the next ``Answer:`` label; null if none."""
    tail = first_match(cleaned, r"(?is)(?:\A|\n)" + WS + "*Reasoning" + WS + "*[:：]" + WS + r"*(.*)\z")
    head = F.regexp_extract(tail, r"(?is)\A(.*?)(?:\n" + WS + "*Answer" + WS + r"*[:：]|\z)", 1)
    return strip(head)


def answer_part(cleaned: Column) -> Column:
    return strip(first_match(cleaned, r"(?is)(?:\A|\n)" + WS + "*Answer" + WS + r"*[:：](.*)\z"))


def shown_reasoning(reasoning: Column) -> Column:
    """Reasoning for display: a fixed note stands in for an empty or not-applicable one."""
    none = (reasoning == "") | F.lower(strip(reasoning)).isin(*NO_REASONING)
    return F.when(none, F.lit(NO_REASONING_TEXT)).otherwise(reasoning)


def shown_answer(answer: Column) -> Column:
    return F.when(answer == "", F.lit(NO_ANSWER_TEXT)).otherwise(answer)


def _upwards(c: Column) -> Column:
    """Stripped lines of the trimmed text, the last line first."""
    return F.transform(F.reverse(lines(strip(c))), strip)


def _choice_in_line(line: Column) -> Column:
    """Choice letter a line ends with or names after an answer phrase; null when neither."""
    at_end = [
        F.when(
            line.endswith(f" {x}.") | line.endswith(f"({x})") | line.endswith(f"{x})")
            | line.endswith(f"{x} ") | line.endswith(f"**{x}**") | line.endswith(f"{x}:**")
            | line.endswith(f"{x}.**"),
            F.lit(x),
        )
        for x in "ABCDEFGH"
    ]
    low = F.lower(line)
    named = []
    for phrase in CHOICE_PHRASES:
        after = F.substring(line, F.position(F.lit(phrase), low) + len(phrase), F.length(line))
        named.append(F.when(low.contains(phrase), first_match(after, "[A-H]", 0)))
    return F.coalesce(*at_end, *named)


def choice_from_lines(c: Column) -> Column:
    """Choice letter from the lowest line that has one; null when no line does."""
    return first_of(F.filter(F.transform(_upwards(c), _choice_in_line), lambda x: x.isNotNull()))


def closing_value(c: Column) -> Column:
    """Number of a short line (five words at most), or the right side of an assignment, within the
    last three lines, searched upwards; null when there is none."""

    def of_line(line: Column) -> Column:
        num = F.when(F.size(words(line)) <= 5, first_match(line, r"-?\d+(?:\.\d+)?", 0))
        assigns = F.lit(False)
        for op in ASSIGNING_OPERATORS:
            assigns = assigns | line.contains(op)
        side = F.when(assigns, strip(F.substring_index(line, "=", -1)))
        return F.coalesce(num, side)

    near = F.slice(_upwards(c), 1, 3)
    return first_of(F.filter(F.transform(near, of_line), lambda x: x.isNotNull()))


def last_line_answer(c: Column) -> Column:
    """Lowest non-empty line without an answer prefix; empty string when the text is blank."""

    def bare(line: Column) -> Column:
        out = line
        for p in reversed(ANSWER_PREFIXES):
            rest = strip(F.substring(line, F.lit(len(p) + 1), F.length(line)))
            out = F.when(F.lower(line).startswith(p), rest).otherwise(out)
        return out

    return let(F.coalesce(first_of(F.filter(_upwards(c), lambda x: x != "")), F.lit("")), bare)


def layered_answer(c: Column) -> Column:
    """Answer tag, else choice letter, else closing value, else the last line."""
    c = text(c)
    return F.coalesce(
        strip(first_match(c, ANSWER_TAG)),
        choice_from_lines(c),
        F.nullif(closing_value(c), F.lit("")),
        last_line_answer(c),
    )


def thinking_part(c: Column) -> Column:
    """Trimmed body of the first think tag; null when absent."""
    return strip(first_match(text(c), THINK_TAG))

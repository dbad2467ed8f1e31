"""String helpers with Python string semantics, built from native Spark functions.

Spark's ``trim`` strips only the space character and Java's ``\\s`` covers only ASCII, so the
whitespace set of ``str.strip`` / ``re`` is spelled out once here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which str.isspace() is true, and the same set as a regex class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}]"
)
NOT_WS = "[^" + WS[1:]
WORD = r"[\p{L}\p{N}_]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def text(c: Column | str) -> Column:
    """The value as a string, null read as the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` mentions it.

    Column expressions are trees: a step that mentions its input three times would otherwise carry,
    and inside conditions also compute, three copies of everything before it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def apart(c: Column) -> Column:
    """The column itself, in a projection of its own functions.

    Spark puts the projections of a stage into one method, and the JVM doesn't compile methods beyond 8,000 bytes; a
    projection with a lambda is cut into small ones.
    """
    return let(c, lambda x: x)


def both(a: Column, b: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of two columns as a two-element array."""
    return F.transform(F.array(a, b), use)


def strip(c: Column) -> Column:
    """One parameter only: a lambda with two would receive the element's index as well."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_read(c: Column) -> Column:
    """As :func:`strip`, for a column that is only read: most texts begin and end with a visible ASCII character, and need no search
    for blanks."""

    def visible(x: Column) -> Column:
        return (x >= "!") & (x < "\x7f")

    return F.when(visible(c) & visible(F.substring(c, -1, 1)), c).otherwise(strip(c))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def rstrip(c: Column, chars: str = WHITESPACE) -> Column:
    return F.rtrim(c, F.lit(chars))


def lstrip(c: Column, chars: str = WHITESPACE) -> Column:
    return F.ltrim(c, F.lit(chars))


def swap(c: Column, old: str, new: str) -> Column:
    """Literal (non-regex) replacement."""
    return F.replace(c, F.lit(old), F.lit(new))


def words(c: Column) -> Column:
    """Whitespace-separated words, no empty ones."""
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def collapse(c: Column) -> Column:
    """Words with one space between them."""
    return F.btrim(F.regexp_replace(c, WS + "+", " "), F.lit(" "))


def collapsed_lower(c: Column) -> Column:
    """``collapse(lower(strip(c)))`` of a column that is only read: the pattern runs where there is more to find than single spaces."""
    return F.when(c.rlike(r"  |[^ -~]"), collapse(F.lower(strip(c)))).otherwise(F.lower(F.trim(c)))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def clean_lines(c: Column) -> Column:
    """Stripped, non-empty lines, broken wherever str.splitlines breaks."""
    return F.filter(F.transform(F.split(c, LINE_BREAK), strip), lambda ln: ln != "")


def has_any(c: Column, needles: Iterable[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | c.contains(n)
    return hit


def count_of(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.octet_length(c) - F.octet_length(swap(c, needle, ""))) / len(needle.encode())).cast("int")


def find(c: Column, needle: Column | str, start: Column | int = 1) -> Column:
    """1-based position of the first occurrence at or after ``start``; 0 when absent."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.position(needle, c, F.lit(start) if isinstance(start, int) else start)


def rfind0(c: Column, needle: Column) -> Column:
    """0-based position of the last occurrence, null when absent."""
    at = F.position(F.reverse(needle), F.reverse(c))
    return F.when(at > 0, F.length(c) - at + 1 - F.length(needle))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null when the pattern is not found."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def last_match(c: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(all_matches(c, pattern, group), F.lit(-1))


def first_of(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def last_of(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))


def number(c: Column) -> Column:
    """Double value or null; never raises under ANSI mode."""
    return c.try_cast("double")


def flag(c: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (null counts as false)."""
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def join_list(arr: Column) -> Column:
    """A list answer as one string: items joined with a comma and a space."""
    return F.array_join(F.transform(arr, lambda x: F.coalesce(x.cast("string"), F.lit("None"))), ", ")


def json_quote(c: Column) -> Column:
    """One JSON string literal, non-ASCII kept."""
    arr = F.to_json(F.array(c))
    return F.substring(arr, F.lit(2), F.length(arr) - 2)

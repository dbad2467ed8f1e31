"""Character-multiset F1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip, text


def shared_chars(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two texts' characters.

    One pass per distinct character that both texts hold, all inside the row: no shuffle.
    """
    count = lambda c, ch: F.length(c) - F.length(F.replace(c, ch, F.lit("")))

    def shared(pair: Column) -> Column:
        chars = lambda i: F.array_distinct(F.split(F.get(pair, F.lit(i)), ""))
        common = F.filter(F.array_intersect(chars(0), chars(1)), lambda ch: ch != "")
        return F.aggregate(
            common, F.lit(0),
            lambda n, ch: n + F.least(count(F.get(pair, F.lit(0)), ch), count(F.get(pair, F.lit(1)), ch)),
        )

    return let(F.array(a, b), shared)


def char_f1(pred: Column, gold: Column) -> Column:
    """F1 of the shared characters; null without a gold text."""
    p, g = strip(text(pred)), strip(text(gold))
    # 2PR / (P + R) with P = both / len(p) and R = both / len(g).
    f1 = F.try_divide(2.0 * shared_chars(p, g), F.length(p) + F.length(g))
    return F.when(g != "", F.coalesce(f1, F.lit(0.0)))

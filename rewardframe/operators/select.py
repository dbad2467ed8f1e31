"""The first rows of a total order, without putting the table in order.

A selection narrows down the range of keys that holds the k-th one: a bounded sample gives two keys that
enclose it, one aggregate counts the rows up to each, and the next round looks at the rows between them alone.  A
few thousand sampled keys leave some hundredths of a range, so two or three rounds reach a range that one
task orders.  What comes out is a bound: the first k rows are a filter, which a scan can use, and no row is
shuffled for it, however wide it is.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 4096  # keys that come to the driver in a round
RANGE = 50_000  # keys that one task orders


def _key(order: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)])


def _literal(df: DataFrame, order: list[str], values: tuple) -> Column:
    kinds = [df.schema[c].dataType for c in order]
    return F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(values, kinds, strict=True))])


def upto(df: DataFrame, order: list[str], values: tuple) -> Column:
    """Whether a row is at the key ``values`` or before it; nulls are first.

    For one column it is a comparison that scans push down.
    """
    if len(order) == 1 and values[0] is not None:
        c = F.col(f"`{order[0]}`")
        return c.isNull() | (c <= F.lit(values[0]).cast(df.schema[order[0]].dataType))
    return _key(order) <= _literal(df, order, values)


def kth_key(df: DataFrame, order: list[str], k: int, sample: int = SAMPLE, bound: int = RANGE) -> tuple[Any, ...] | None:
    """Key of the k-th row (from 1) in the order of the columns ``order``; None if there are fewer rows.

    Every round reads the key columns of ``df``: settle it first if it is dear.
    """
    keys = df.select(*[F.col(f"`{c}`") for c in order])
    size = keys.count()
    if not 1 <= k <= size:
        return None
    inside, below = keys, 0
    for seed in range(64):
        if size <= bound:
            break
        drawn = sorted_rows(inside.sample(fraction=min(1.0, sample / size), seed=seed), order)
        at, spread = (k - below) / size * len(drawn), 2 * math.sqrt(len(drawn)) + 1
        low, high = math.floor(at - spread), math.ceil(at + spread)
        ends = [drawn[i] for i in (low, high) if 0 <= i < len(drawn)]
        if not ends:
            continue
        counts = inside.agg(*[F.count(F.when(upto(keys, order, e), 1)) for e in ends]).first()
        # The k-th key is after all ends with fewer rows, and not after the first with enough.
        before = [(n, e) for n, e in zip(counts, ends, strict=True) if below + n < k]
        after = [(n, e) for n, e in zip(counts, ends, strict=True) if below + n >= k]
        top = size
        if after:
            top, end = after[0]
            inside = inside.filter(upto(keys, order, end))
        if before:
            n, end = before[-1]
            inside = inside.filter(~upto(keys, order, end))
            below, top = below + n, top - n
        size = top
    place = F.row_number().over(Window.orderBy(*order))
    return tuple(inside.withColumn("_place", place).filter(F.col("_place") == k - below).select(*order).first())


def sorted_rows(df: DataFrame, order: list[str]) -> list[tuple]:
    """The rows of a small table in the order of ``order``."""
    return [tuple(r) for r in df.sort(*order).collect()]


def first_k(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first k rows in the order of ``order``, which must be total; all rows if there are no more."""
    if k <= 0:
        return df.limit(0)
    last = kth_key(df, order, k)
    return df if last is None else df.filter(upto(df, order, last))

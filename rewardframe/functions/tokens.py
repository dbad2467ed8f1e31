"""Token-array work: padding, loss masks, completion masks, image slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

IGNORE = -100


def pad_right(ids: Column, length: int, pad: int) -> Column:
    """First ``length`` ids, padded on the right."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def pad_left(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), length - F.size(ids)), ids)


def int_array(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _starts(ids: Column, marker: list[int]) -> Column:
    """0-based positions at which the marker sequence starts."""
    at = F.filter(F.transform(ids, lambda x, i: F.when(x == marker[0], i)), lambda i: i.isNotNull())
    return F.filter(at, lambda i: F.slice(ids, i + 1, F.lit(len(marker))) == int_array(marker))


def answer_spans(ids: Column, start: list[int], end: list[int], max_length: int) -> Column:
    """Half-open [from, to) spans after each start marker through the next end marker."""
    return let(ids, lambda x: let(_starts(x, end), lambda ends: _spans(x, ends, start, end, max_length)))


def _spans(ids: Column, ends: Column, start: list[int], end: list[int], max_length: int) -> Column:
    entry = "array<struct<a:int,b:int>>"

    def step(acc: Column, at: Column) -> Column:
        a = at + len(start)
        stop = F.array_min(F.filter(ends, lambda e: e >= a))
        free = F.coalesce(stop + len(end), F.size(ids))
        b = F.least(F.coalesce(stop, F.size(ids)) + len(end), F.lit(max_length), F.size(ids))
        grown = F.concat(acc["spans"], F.array(F.struct(a.alias("a"), b.alias("b"))))
        return F.when(
            at >= acc["free"], F.struct(free.alias("free"), grown.alias("spans"))
        ).otherwise(acc)

    first = F.struct(F.lit(0).alias("free"), F.array().cast(entry).alias("spans"))
    return F.aggregate(_starts(ids, start), first, step, lambda acc: acc["spans"])


def loss_labels(ids: Column, start: list[int], end: list[int], max_length: int) -> Column:
    """Ids inside answer spans, the ignore label elsewhere."""

    def within(spans: Column) -> Column:
        return F.transform(
            ids,
            lambda x, i: F.when(F.exists(spans, lambda s: (i >= s["a"]) & (i < s["b"])), x).otherwise(F.lit(IGNORE)),
        )

    return let(answer_spans(ids, start, end, max_length), within)


def prompt_length(ids: Column, labels: Column, pad: int) -> Column:
    """Position of the first label, else the length without trailing pads, else the whole length."""
    first = F.array_position(F.transform(labels, lambda x: x != IGNORE), F.lit(True))
    tail = F.array_position(F.reverse(F.transform(ids, lambda x: x != pad)), F.lit(True))
    return (
        F.when(first > 0, first - 1)
        .when(tail > 0, F.size(ids) - tail + 1)
        .otherwise(F.size(ids))
        .cast("int")
    )


def labelled_ids(ids: Column, labels: Column) -> Column:
    """Ids at the positions that carry a label."""
    kept = F.zip_with(ids, labels, lambda x, y: F.when(y != IGNORE, x))
    return F.filter(kept, lambda x: x.isNotNull())


def until_eos(ids: Column, eos: int) -> Column:
    """Ids up to and including the first end token."""
    at = F.array_position(ids, F.lit(eos)).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), at)).otherwise(ids)


def completion_mask(ids: Column, eos: int) -> Column:
    """1 up to and including the first end token, 0 after it."""
    n = F.size(until_eos(ids, eos))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.size(ids) - n))


def image_runs(ids: Column, marker: int) -> Column:
    """Start and length of every unbroken run of the image marker."""
    here = lambda cond: F.filter(cond, lambda i: i.isNotNull())
    edge = lambda x, side: F.coalesce(side != marker, F.lit(True)) & (x == marker)

    def runs(v: Column) -> Column:
        first = here(F.transform(v, lambda x, i: F.when(edge(x, F.get(v, i - 1)), i)))
        last = here(F.transform(v, lambda x, i: F.when(edge(x, F.get(v, i + 1)), i)))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("at"), (b - a + 1).alias("n")))

    return let(ids, runs)

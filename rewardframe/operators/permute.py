"""Epoch orders as keyed bijections: the place of a row in an epoch follows from its number alone.

Rows are numbered once, densely.  An epoch maps the numbers 0..n-1 onto themselves by a Feistel network over
a grid of about the square root of n on each side; a number that falls on one of the few cells beyond n
goes through the network again until it is back inside.  So no epoch needs a sort or a shuffle, and the rows of
any batch of any shard are computed backwards from their places.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .ranks import order_rank

ROUNDS = 6
WALKS = 32  # a chain of cells beyond n is shorter than the grid's side; longer ones are next to impossible, and an error


def sides(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid of n cells or more."""
    wide = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return wide, max(1, -(-n // wide))


def numbered(df: DataFrame, id_col: str) -> DataFrame:
    """(id, row): the rows of a table with dense numbers in the order of a unique id, written once."""
    return settled(order_rank(df.select(id_col), [id_col], "row"))


def _draw(seed: str, step: int, value: int) -> int:
    return int(hashlib.md5(f"{seed}-{step}-{value}".encode()).hexdigest()[:12], 16)


def _draws(n: int, seed: str) -> list[np.ndarray]:
    """Draws of each round for all rows or columns of the grid: about the square root of n of them."""
    wide, high = sides(n)
    sizes = [high if step % 2 == 0 else wide for step in range(ROUNDS)]
    return [np.fromiter((_draw(seed, step, v) for v in range(size)), "int64", size) for step, size in enumerate(sizes)]


def _network(x: np.ndarray, n: int, draws: list[np.ndarray]) -> np.ndarray:
    wide, high = sides(n)
    left, right = x % wide, x // wide
    for step, draw in enumerate(draws):
        if step % 2 == 0:
            left = (left + draw[right]) % wide
        else:
            right = (right + draw[left]) % high
    return right * wide + left


def _places(rows: np.ndarray, n: int, draws: list[np.ndarray]) -> np.ndarray:
    """Places of row numbers, all from 0 to n - 1."""
    if len(rows) and not 0 <= rows.min() <= rows.max() < n:
        raise ValueError(f"row numbers go from 0 to {n - 1}")
    out = _network(rows, n, draws)
    for _ in range(WALKS):
        beyond = np.flatnonzero(out >= n)
        if not len(beyond):
            return out
        out[beyond] = _network(out[beyond], n, draws)
    if (out >= n).any():
        raise ValueError("a chain of cells beyond the table is too long")
    return out


def place_of(row: Column, n: int, seed: str) -> Column:
    """Place of a row in the order of a seed; null without a row number.

    Whole Arrow batches go through the network, and a task hashes each row and column of the grid once a round.
    """
    if n <= 1:
        return row

    @F.pandas_udf("bigint")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        draws = _draws(n, seed)
        for rows in batches:
            known = rows.notna().to_numpy()
            out = pd.Series(0, index=rows.index, dtype="Int64")
            out[known] = _places(rows[known].to_numpy("int64"), n, draws)
            out[~known] = pd.NA
            yield out

    return place(row.cast("bigint"))


def row_at(place: int, n: int, seed: str) -> int:
    """The row at a place: the network backwards."""
    if n <= 1:
        return place
    wide, high = sides(n)
    while True:
        left, right = place % wide, place // wide
        for step in reversed(range(ROUNDS)):
            if step % 2 == 0:
                left = (left - _draw(seed, step, right)) % wide
            else:
                right = (right - _draw(seed, step, left)) % high
        place = right * wide + left
        if place < n:
            return place


def epoch_order(rows: DataFrame, n: int, seed: int, epoch: int, batch_size: int, shards: int = 1, skip_batches: int = 0) -> DataFrame:
    """The ``n`` numbered rows with their position, shard and batch in an epoch.

    Shards are filled as in ``split.epoch_plan``: positions go on from n with the first rows again.
    """
    out = rows.withColumn("position", place_of(F.col("row"), n, f"{seed + epoch}"))
    if shards > 1 and n:
        last = F.lit(-(-n // shards) * shards - 1).cast("bigint")
        out = out.withColumn("position", F.explode(F.sequence(F.col("position"), last, F.lit(n).cast("bigint"))))
    in_shard = F.floor(F.col("position") / shards)
    return (
        out.withColumn("shard", (F.col("position") % shards).cast("int"))
        .withColumn("batch", F.floor(in_shard / batch_size).cast("bigint"))
        .filter(F.col("batch") >= skip_batches)
    )


def batch_rows(n: int, seed: int, epoch: int, batch_size: int, shard: int, batch: int, shards: int = 1) -> list[int]:
    """Numbers of the rows of one batch, in order; nothing else of the epoch is computed."""
    per_shard = -(-n // shards)
    places = range(batch * batch_size, min((batch + 1) * batch_size, per_shard))
    return [row_at((p * shards + shard) % n, n, f"{seed + epoch}") for p in places]


def one_batch(rows: DataFrame, n: int, seed: int, epoch: int, batch_size: int, shard: int, batch: int, shards: int = 1) -> DataFrame:
    """One batch as a filter on the numbered rows, which their scan can use."""
    return rows.filter(F.col("row").isin(batch_rows(n, seed, epoch, batch_size, shard, batch, shards)))

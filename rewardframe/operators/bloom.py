"""Bloom filters as tables: built by a partial aggregate, tested in the scan.

The filter is cut into blocks of 4 KB.  An id sets ``PROBES`` bits of one block; the bits of a block are collected by
the built-in bitmap aggregate, so building shuffles blocks, not ids.  A tested row looks at its own block
only, which it finds by a hash join with the table of blocks.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

BLOCK = 32_768  # bits of a block, fixed by the bitmap aggregate
PER_ID = 12  # bits for each id
PROBES = 6
LARGEST = 64 << 20  # bytes of a filter that is sent to the tasks; a table of more ids is joined directly


def _bits(key: Column) -> list[Column]:
    """Bits of an id in its block, from 15-bit pieces of two hashes."""
    one, two = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    cut = lambda h, i: F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BLOCK - 1)).cast("int")
    return [cut(h, i) for h in (one, two) for i in range(PROBES // 2)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)).cast("int")


def bloom_blocks(ids: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, bitmap) of the ids."""
    rows = ids.select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_bits(F.col(key)))).alias("bit"))
    return rows.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    octet = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return octet.bitwiseAND(F.pow(F.lit(2), F.pmod(bit, F.lit(8))).cast("int")) != 0


def maybe_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is among the distinct ``ids``, and about one in a hundred of the others at most.

    The filter grows with the ids (``PER_ID`` bits each); beyond ``LARGEST`` bytes the rows are returned as they are.
    """
    blocks = max(1, -(-ids.count() * PER_ID // BLOCK))
    if blocks * BLOCK // 8 > LARGEST:
        return df
    table = settled(bloom_blocks(ids, key, blocks)).select(F.col("block").alias("_bloom_of"), F.col("bitmap").alias("_bloom_bits"))
    asked = df.withColumn("_bloom_block", _block(F.col(key), blocks))
    asked = asked.join(F.broadcast(table), F.col("_bloom_block") == F.col("_bloom_of"))
    tests = [_is_set(F.col("_bloom_bits"), b) for b in _bits(F.col(key))]
    return asked.filter(functools.reduce(Column.__and__, tests)).select(*[F.col(f"`{c}`") for c in df.columns])

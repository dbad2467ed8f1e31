"""Stable hashes that give the same split and order on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**96, 2**64, 2**32 and 1 modulo 10000, the weights of the four 32-bit parts of an md5.
_PART_WEIGHTS = (336, 1616, 7296, 1)


def stable_percent(seed: str, sample_id: Column) -> Column:
    """md5 of "seed-id" as a whole number modulo 10000."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), sample_id.cast("string")))
    total = F.lit(0).cast("bigint")
    for i, w in enumerate(_PART_WEIGHTS):
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        total = total + part * w
    return (total % 10000).cast("int")

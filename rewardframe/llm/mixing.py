"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the word budget by its weight; shares are clamped at ``max_epochs``
times the source's size, and the excess is dealt again by weight among the others until no share is
above its clamp.  A share is met by whole repetitions of the source and one fractional repetition:
the documents whose seeded hash lies under a cut.  The cut of a source is found on sums of hash
blocks, then inside one block, so no source is sorted in one task.

Defined cases: a null or empty text has size 0 and is taken as often as its neighbours, with no
words; a null source is a source of its own, last in order; repeated rows share a hash and are taken
alike; rows without an id have the hash of their text, so equal texts among them are taken alike; a source without words has target 0; if the budget exceeds all clamps, every source is taken
``max_epochs`` times; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, settle

WEIGHTS = (3, 1, 2)
BUDGET = 150  # per cent of all words
MAX_EPOCHS = 2
SEED = "mix-1"
_DIGITS = 15  # hex digits of the hash: 60 bits
_BLOCK = 1 << 44  # hash values in a block: 65,536 blocks


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits from the id, or where there is none from the text."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))))
    return F.conv(F.substring(F.md5(key), 1, _DIGITS), 16, 10).cast("bigint")


def weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds the weight of each source: the list repeats over the sources by code point, null last.

    Positions come from range partitions of the narrow source table and their sizes.
    """
    order = [F.col("source").isNull().alias("none"), F.col("source")]
    parts = settle(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    place = F.col("offset") + F.row_number().over(inside) - 1
    weight = F.get(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int")).cast("bigint")
    return parts.join(sizes, "part").withColumn("weight", weight).drop("part", "offset")


def water_fill(sources: DataFrame, percent: int, max_epochs: int) -> DataFrame:
    """Adds the target of each source (source, source_size, weight).

    Each round clamps the sources whose share reaches their clamp; the level of the others follows
    from a few sums, so only sums come to the driver, never sources.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level = total * percent / 100, 0.0  # level: words for a unit of weight
    while True:
        clamped = cap <= F.lit(level) * F.col("weight")
        full, free = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        if not free:
            break
        raised = (budget - (full or 0)) / free
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds whole (repetitions) and cut (largest hash that is taken once more, -1 for none)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    sources = sources.withColumn("whole", whole)
    sources = settle(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    blocks = sized.groupBy("source", F.expr(f"hash div {_BLOCK}").alias("block")).agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = sources.select(F.col("source").alias("s"), "rest")
    edge = (
        blocks.withColumn("upto", F.sum("n").over(upto))
        .join(rest, F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        .groupBy("s").agg(F.min(F.struct("block", (F.col("upto") - F.col("n")).alias("before"), "rest")).alias("edge"))
        .select("s", "edge.*")
    )
    edge = settle(edge)
    # Rows with one hash are taken together: sum them before they are put in order.
    inner = (
        sized.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.expr(f"hash div {_BLOCK}") == F.col("block")))
        .groupBy("s", "hash").agg(F.sum("size").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    )
    within = Window.partitionBy("s").orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("n").over(within) - F.col("n") / 2
    last = (
        inner.withColumn("middle", middle)
        .groupBy("s").agg(F.max(F.when(F.col("middle") <= F.col("rest"), F.col("hash"))).alias("last"))
    )
    # No document of the edge block: everything under the block.
    last = last.select(F.col("s").alias("t"), "last")
    found = edge.join(last, F.col("s").eqNullSafe(F.col("t")), "left").select(
        "s", F.coalesce("last", F.col("block") * _BLOCK - 1).alias("cut")
    )
    return sources.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest").withColumn(
        "cut", F.coalesce("cut", F.lit(-1).cast("bigint"))
    )


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, percent: int = BUDGET, max_epochs: int = MAX_EPOCHS,
    seed: str = SEED, keep: bool = False,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``keep`` adds ``doc``, the row's own columns.  ``taken`` is size times copies; the words taken
    from a source differ from its target by less than the document at its cut.
    """
    def sized(own: list[Column]) -> DataFrame:
        return docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"),
            seeded_hash(F.col(doc_id), F.col(text), seed).alias("hash"), *own,
        )

    narrow = settle(sized([]))
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = cuts(narrow, water_fill(settle(weighted(totals, weights)), percent, max_epochs))
    plan = settle(plan.withColumnRenamed("source", "s"))
    rows = sized([packed(docs).alias("doc")]) if keep else narrow
    copies = F.col("whole") + (F.col("hash") <= F.col("cut")).cast("bigint")
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copies", F.least(copies, F.lit(max_epochs)))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("s", "hash", "whole", "cut", "weight")
    )

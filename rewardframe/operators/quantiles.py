"""Exact percentiles in bounded memory.

A mergeable sketch gives, for each percentile of each group, two values between which it must lie; a second
pass counts the rows before that bracket and looks at the values inside it alone.  A bracket holds a few
thousandths of the rows; where that is still too much for one task, the next sketch is taken inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

ACCURACY = 2000  # of the sketch: ranks are right to one in so many
INSIDE = 100_000  # rows of a bracket that one task puts in order
ROUNDS = 4  # each leaves about a tenth of a bracket at worst, a thousandth where values differ


def _bracketed(df: DataFrame, brackets: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Rows (groups, p, value, side) with one row per percentile: side 0 before the bracket, 1 inside."""
    same = F.lit(True)
    names = {g: f"_b{i}" for i, g in enumerate(groups)}
    for g, b in names.items():
        same = same & F.col(g).eqNullSafe(F.col(b))
    told = brackets.select(*[F.col(g).alias(b) for g, b in names.items()], "p", "low", "high", "done")
    per_group = told.groupBy(*names.values()).agg(F.collect_list(F.struct("p", "low", "high", "done")).alias("_told"))
    rows = df.select(*groups, F.col(value).alias("value")).filter("value IS NOT NULL")
    joined = rows.join(per_group, same) if groups else rows.join(F.broadcast(per_group))
    open_ = joined.select(*groups, "value", F.explode("_told").alias("t")).filter("NOT t.done AND value <= t.high")
    return open_.select(*groups, F.col("t.p").alias("p"), "value", (F.col("value") >= F.col("t.low")).cast("int").alias("side"))


def exact_percentiles(
    df: DataFrame, groups: list[str], value: str, ps: list[float], accuracy: int = ACCURACY, inside: int = INSIDE,
) -> DataFrame:
    """(groups, p, value) with the linear-interpolation percentile ``p`` of the non-null numbers ``value``.

    Groups with nulls alone, and tables without rows, give no rows.  ``df`` is read once per pass: settle it first if
    it is dear.  The percentiles of a group travel together (there are as many as ``ps``).
    """
    rows = df.select(*[F.col(g) for g in groups], F.col(value).cast("double").alias("value"))
    margin = 2 / accuracy
    points = [min(max(p + s, 0.0), 1.0) for p in ps for s in (-margin, margin)]
    sketch = F.percentile_approx("value", F.array(*map(F.lit, points)), F.lit(accuracy))
    first = rows.filter("value IS NOT NULL").groupBy(*groups).agg(F.count("*").alias("n"), sketch.alias("s"))
    each = F.array(*[F.struct(F.lit(p).alias("p"), F.get("s", F.lit(2 * i)).alias("low"), F.get("s", F.lit(2 * i + 1)).alias("high")) for i, p in enumerate(ps)])
    brackets = first.select(*groups, "n", F.explode(each).alias("e")).select(*groups, "n", "e.p", "e.low", "e.high", F.lit(False).alias("done"))
    brackets = settled(brackets)
    rank: Column = F.col("p") * (F.col("n") - 1)
    need_low, need_high = F.floor(rank), F.ceil(rank)  # from 0
    keys = [*groups, "p"]
    rounds = 0
    while True:
        sides = _bracketed(rows, brackets, groups, "value").groupBy(*keys).agg(
            F.count(F.when(F.col("side") == 0, 1)).alias("before"), F.count(F.when(F.col("side") == 1, 1)).alias("held"),
            F.max(F.when(F.col("side") == 1, F.col("value"))).alias("top"),
            F.percentile_approx(F.when(F.col("side") == 1, F.col("value")), F.array(*[F.lit(i / 20) for i in range(21)]), F.lit(accuracy)).alias("cuts"),
        )
        state = settled(_with(brackets, sides, keys))
        # A bracket that misses its ranks, as the sketch may where ties pile up, is opened to both ends.
        missed = (F.col("before") > need_low) | (F.col("before") + F.col("held") <= need_high)
        if state.filter(missed).limit(1).count():
            wide = F.when(missed, F.lit(float("-inf"))).otherwise(F.col("low")), F.when(missed, F.lit(float("inf"))).otherwise(F.col("high"))
            brackets = settled(state.select(*groups, "n", "p", wide[0].alias("low"), wide[1].alias("high"), "done"))
            rounds = ROUNDS
            continue
        large = (F.col("held") > inside) & (F.col("low") < F.col("high"))
        if rounds >= ROUNDS or not state.filter(large).limit(1).count():
            break
        rounds += 1
        at = (need_low - F.col("before")) / F.col("held") * 20
        low = F.get("cuts", F.greatest(F.floor(at - 0.5), F.lit(0)).cast("int"))
        high = F.get("cuts", F.least(F.ceil(at + 0.5) + 1, F.lit(20)).cast("int"))
        narrowed = state.select(*groups, "n", "p", F.when(large, low).otherwise(F.col("low")).alias("low"), F.when(large, high).otherwise(F.col("high")).alias("high"), "done", "low", "high")
        narrowed = narrowed.toDF(*groups, "n", "p", "low", "high", "done", "old_low", "old_high")
        if not narrowed.filter("low > old_low OR high < old_high").limit(1).count():
            break
        brackets = settled(narrowed.drop("old_low", "old_high"))
    values = _bracketed(rows, brackets, groups, "value").filter("side = 1").groupBy(*keys, "value").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy("value")
    ranked = _with(values.withColumn("upto", F.sum("c").over(upto)), state.select(*keys, "n", "before"), keys)
    after = F.col("before") + F.col("upto")
    pick = lambda need: F.min(F.when(after > need, F.col("value")))
    out = ranked.groupBy(*keys, "n").agg(pick(need_low).alias("a"), pick(need_high).alias("b"))
    return out.select(*keys, (F.col("a") + (rank - need_low) * (F.col("b") - F.col("a"))).alias("value"))


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null."""
    named = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return left.join(named, same).drop(*[f"_r{i}" for i in range(len(keys))])

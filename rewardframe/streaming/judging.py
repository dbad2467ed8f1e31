"""Judge scoring over a request stream, and counts of requests by window.

Every request is answered, whenever it comes; nothing depends on event time but the age of cache
entries.  Scores live in the state of the stream (``pool``), so a micro-batch costs what its own
requests cost, however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.judging import rule_judge
from ..operators.judge import JudgeFn, request_key
from .pool import BUCKETS, pooled

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_PARTIAL = "window_start timestamp, requests long, late long, newest timestamp, batch int"


@contextmanager
def _stream_settings(spark: SparkSession, drain: bool) -> Iterator[None]:
    """Settings of queries started inside: state stores are RocksDB, which keeps state on disk and writes
    changes only; a query that drains its source runs no micro-batches for timers, as nothing waits."""
    own = {_PROVIDER: _ROCKS} | ({_IDLE_BATCHES: "false"} if drain else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def with_cached(requests: DataFrame, cache: DataFrame | None, ttl_seconds: int, ts: str) -> DataFrame:
    """Requests with ``cached_score``: that of an entry (key, score, ts) younger than the TTL, else null."""
    if cache is None:
        return requests.withColumn("cached_score", F.lit(None).cast("double"))
    entries = cache.select("key", F.col("score").alias("cached_score"), F.col("ts").alias("cached_at"))
    fresh: Column = F.col(ts).cast("double") - F.col("cached_at").cast("double") < ttl_seconds
    joined = requests.join(entries, "key", "left")
    return joined.withColumn("cached_score", F.when(fresh, F.col("cached_score"))).drop("cached_at")


def _by_rule(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"score": part["rule_score"], "explanation": ""})


def start_judging(
    stream: DataFrame, out: str, checkpoint: str, judge: JudgeFn | None = None, context: tuple[str, ...] = (),
    cache: DataFrame | None = None, ttl_seconds: int = 3600, batch_size: int = 32, wait_ms: int = 100,
    interval: str | None = None, request_id: str = "request_id", ts: str = "ts",
    buckets: int = BUCKETS, retries: int = 3, delay: float = 0.5,
) -> StreamingQuery:
    """Answers every request of the stream under ``out``/answers/batch=N.

    Rows are (request_id, key, score, source, judged, failed, calls, waited_ms), source being ``cache`` or
    ``judge``.  A replayed micro-batch overwrites its own folder.  Without a ``judge`` requests are scored by
    the built-in rules, as a native expression.  A score serves its key for ``ttl_seconds``.

    ``interval`` is the trigger (such as "100 milliseconds"): a call of the judge is made when ``batch_size``
    keys of a bucket wait, or when the first has waited ``wait_ms``.  Without it the query drains what is
    available, lets nothing wait, and stops.
    """
    rows = stream.withColumn("key", request_key())
    if judge is None:
        verdict = rule_judge(F.col("prompt"), F.col("completion"), F.col("answer"))
        rows, judge, context = rows.withColumn("rule_score", verdict["score"]), _by_rule, (*context, "rule_score")
    asked = with_cached(rows, cache, ttl_seconds, ts)
    answered = pooled(
        asked, judge, request_id, context, batch_size, wait_ms if interval else 0, ttl_seconds, buckets, retries, delay,
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumnRenamed("request_id", request_id).write.mode("overwrite").parquet(f"{out}/answers/batch={number}")

    with _stream_settings(stream.sparkSession, interval is None):
        writer = answered.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def answers(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/answers")


def stream_metrics(spark: SparkSession, out: str) -> DataFrame:
    """Figures of all micro-batches so far: requests, cache hits, requests served by a score of before
    or by a call made for another one, keys judged, calls of the judge, and errors."""
    count = lambda c: F.count(F.when(c, 1))
    sums = answers(spark, out).agg(
        F.count("*").alias("requests"), count(F.col("source") == "cache").alias("hits"), count(F.col("judged")).alias("judged"),
        F.coalesce(F.sum("calls"), F.lit(0)).cast("bigint").alias("judge_batches"), count(F.col("failed")).alias("errors"),
    )
    repeats = (F.col("requests") - F.col("hits") - F.col("judged")).alias("repeats")
    return sums.select("requests", "hits", repeats, "judged", "judge_batches", "errors")


# --- Windows -------------------------------------------------------------------------------------
# Counts are partial: each micro-batch writes the counts of its own rows, and readers add them up by window.
# No row is too late for a sum, so the delay only says which windows are taken as closed.


def _partials(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema(_PARTIAL).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _PARTIAL)


def start_window_counts(
    stream: DataFrame, out: str, checkpoint: str, width: str, delay: str, ts: str = "ts", every: int = 50,
    interval: str | None = None,
) -> StreamingQuery:
    """Counts requests per tumbling window under ``out``/batch=N.

    Rows older than the newest of the earlier micro-batches less ``delay`` are counted like all others, and
    also as ``late``.  Every ``every`` micro-batches the partial counts of before become one folder, so readers meet
    few of them; a replayed micro-batch writes the same rows again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The newest row so far is in one of the sums; a replayed micro-batch looks at the ones before it only.
        before = _counted(spark, out, number - 1)
        bound = before.agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("bound")).first()["bound"]
        late = F.lit(False) if bound is None else F.col(ts) < F.lit(bound)
        own = batch.groupBy(F.window(ts, width).alias("w")).agg(
            F.count("*").alias("requests"), F.count(F.when(late, 1)).alias("late"), F.max(ts).alias("newest"),
        ).select(F.col("w.start").alias("window_start"), "requests", "late", "newest")
        own.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number and number % every == 0:
            _merge(spark, out, number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def _merge(spark: SparkSession, out: str, number: int) -> None:
    """Adds up the partial counts of the micro-batches up to ``number`` into one table beside them.

    The table names the last micro-batch that it holds, so readers know which folders it stands for, and an
    unfinished one is ignored.
    """
    rows = _counted(spark, out, number)
    rows.write.mode("overwrite").parquet(f"{out}_merged/upto={number}")


def _merged_upto(spark: SparkSession, out: str, limit: int | None) -> int:
    """The last micro-batch held by a merged table, -1 for none."""
    try:
        rows = spark.read.schema("requests long, upto int").parquet(f"{out}_merged")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    if limit is not None:
        rows = rows.filter(F.col("upto") <= limit)
    return rows.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]


def _counted(spark: SparkSession, out: str, limit: int | None = None) -> DataFrame:
    """Sums by window over the micro-batches up to ``limit``: the last merged table and the folders after it."""
    upto = _merged_upto(spark, out, limit)
    rows = _partials(spark, out).filter(F.col("batch") > upto)
    if limit is not None:
        rows = rows.filter(F.col("batch") <= limit)
    rows = rows.drop("batch")
    if upto >= 0:
        rows = rows.unionByName(spark.read.schema("window_start timestamp, requests long, late long, newest timestamp").parquet(f"{out}_merged/upto={upto}"))
    return rows.groupBy("window_start").agg(F.sum("requests").alias("requests"), F.sum("late").alias("late"), F.max("newest").alias("newest"))


def window_counts(spark: SparkSession, out: str, delay: str | None = None) -> DataFrame:
    """(window_start, requests, late) of every window; with a ``delay`` also ``closed``: whether rows of
    the window would be late by now."""
    counts = _counted(spark, out)
    if delay is not None:
        newest = counts.agg(F.max("newest")).scalar()
        counts = counts.withColumn("closed", F.col("newest") < newest - F.expr(f"INTERVAL {delay}"))
    return counts.drop("newest")

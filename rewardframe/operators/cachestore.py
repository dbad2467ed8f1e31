"""A cache of scores that outgrows rewriting: a log of changes by key bucket.

``folder``/bucket=B holds files of entries (key, score, ts).  New scores are appended to the buckets of
their keys; the latest entry of a key counts.  Now and then the buckets with many files are compacted, each into
one; the others are not touched.  Eviction keeps the newest ``max_size`` keys: a histogram of entries by hour gives the
hour that holds the border, and only that hour is looked at more closely.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled
from .select import first_k

BUCKETS = 64
_ENTRY = "key string, score double, ts timestamp, bucket int"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _log(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(_ENTRY).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ENTRY)


def add_scores(scored: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Appends (key, score, ts) to the buckets of their keys, one file for each bucket that changes."""
    rows = scored.select("key", F.col("score").cast("double"), F.col("ts").cast("timestamp"), _bucket(F.col("key"), buckets).alias("bucket"))
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(folder)


def _latest(rows: DataFrame) -> DataFrame:
    """One entry per key, the latest."""
    return rows.groupBy("bucket", "key").agg(F.max(F.struct("ts", "score")).alias("e")).select("key", "e.score", "e.ts", "bucket")


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(key, score, ts) of all keys."""
    return _latest(_log(spark, folder)).drop("bucket")


def lookup_scores(requests: DataFrame, folder: str, now: Column, ttl_seconds: int = 3600, buckets: int = BUCKETS) -> DataFrame:
    """Requests (with ``key``) with the score of an entry younger than the TTL and a ``hit`` flag.

    Both sides carry the bucket, so that buckets without requests are not read where Spark prunes at runtime.
    """
    age = now.cast("double") - F.col("ts").cast("double")
    fresh = _latest(_log(requests.sparkSession, folder)).filter(age < ttl_seconds).select("bucket", "key", "score", F.lit(True).alias("hit"))
    asked = requests.withColumn("bucket", _bucket(F.col("key"), buckets))
    return asked.join(fresh, ["bucket", "key"], "left").drop("bucket").withColumn("hit", F.coalesce("hit", F.lit(False)))


def _rewrite(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """Replaces the buckets of ``rows`` by them; other buckets stay as they are."""
    kept = settled(rows)
    kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def compact(spark: SparkSession, folder: str, files: int = 8) -> list[int]:
    """Merges the files of every bucket that has ``files`` of them or more; returns those buckets (there are
    ``BUCKETS`` at most)."""
    log = _log(spark, folder)
    if not log.inputFiles():
        return []
    counts = log.select("bucket", F.col("_metadata.file_path").alias("file")).distinct().groupBy("bucket").agg(F.count("*").alias("n"))
    full = sorted(r["bucket"] for r in counts.filter(F.col("n") >= files).collect())
    if full:
        _rewrite(spark, _latest(log.filter(F.col("bucket").isin(full))), folder)
    return full


def evict(spark: SparkSession, folder: str, max_size: int) -> int:
    """Drops the oldest keys above ``max_size``, ties by key; returns how many went.

    Buckets without such keys are not touched.
    """
    latest = _latest(_log(spark, folder))
    hour = F.date_trunc("hour", F.col("ts")).alias("hour")
    # As many rows as the cache spans hours.
    histogram = latest.groupBy(hour).agg(F.count("*").alias("n")).orderBy(F.col("hour").desc()).collect()
    before = 0
    for r in histogram:
        if before + r["n"] > max_size:
            border = r["hour"]
            break
        before += r["n"]
    else:
        return 0
    inside = settled(latest.filter(F.date_trunc("hour", F.col("ts")) == F.lit(border)).select("key", "ts", (-F.unix_micros("ts")).alias("age")))
    stay = first_k(inside, ["age", "key"], max_size - before).select("key")
    older = F.date_trunc("hour", F.col("ts")) < F.lit(border)
    gone = settled(
        latest.filter(older).select("bucket", "key")
        .unionByName(latest.join(inside.select("key").join(stay, "key", "left_anti"), "key", "left_semi").select("bucket", "key"))
    )
    touched = sorted(r["bucket"] for r in gone.select("bucket").distinct().collect())
    rest = latest.filter(F.col("bucket").isin(touched)).join(gone.select("key"), "key", "left_anti").select("key", "score", "ts", "bucket")
    rest = settled(rest)
    empty = set(touched) - {r["bucket"] for r in rest.select("bucket").distinct().collect()}
    _rewrite(spark, rest, folder)
    # A bucket that lost all its keys is not among the rewritten ones.
    for bucket in empty:
        spark.createDataFrame([], "key string, score double, ts timestamp").write.mode("overwrite").parquet(f"{folder}/bucket={bucket}")
    return gone.count()

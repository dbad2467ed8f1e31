"""Judge scoring: keys, deduplication, cache, batches, calls with retries, fallback, metrics."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.judging import rule_judge
from ..session import settled
from ..sources.files import add_lines, read_lines
from .ranks import hash_rank
from .select import first_k

KEY_COLUMNS = ("prompt", "completion", "answer", "answer_type")
MAX_BATCH = 128  # Fixed value: largest batch a judge accepts.
# Takes one pandas batch of requests, gives a score and an explanation for each row.
JudgeFn = Callable[[pd.DataFrame], pd.DataFrame]


def check_batch(size: int) -> None:
    if not 1 <= size <= MAX_BATCH:
        raise ValueError(f"a batch holds 1 to {MAX_BATCH} requests, not {size}")


def request_text(columns: tuple[str, ...] = KEY_COLUMNS) -> Column:
    """Key text of a request; a missing value reads "None"."""
    return F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns])


def request_key(columns: tuple[str, ...] = KEY_COLUMNS) -> Column:
    return F.md5(request_text(columns))


def unique_requests(df: DataFrame, context: tuple[str, ...] = ()) -> DataFrame:
    """One row per key with the columns a judge needs; ``context`` is taken from one of its requests,
    the smallest by value."""
    keyed = df.withColumn("key", request_key())
    if not context:
        return keyed.select("key", *KEY_COLUMNS).dropDuplicates(["key"])
    least = keyed.groupBy("key", *KEY_COLUMNS).agg(F.min(F.struct(*context)).alias("_c"))
    return least.select("key", *KEY_COLUMNS, *[F.col(f"_c.{c}").alias(c) for c in context])


def rule_judged(requests: DataFrame) -> DataFrame:
    """Scores of the built-in rule judge, native."""
    verdict = rule_judge(F.col("prompt"), F.col("completion"), F.col("answer"))
    return requests.select("key", verdict.alias("v")).select("key", "v.score", "v.explanation")


def call_judge(judge: JudgeFn, part: pd.DataFrame, retries: int = 3, delay: float = 0.5) -> pd.DataFrame:
    """Answers (key, score, explanation, failed) of a judge to one batch of requests.

    A failing batch is retried, then halved until the failing requests are alone; a ``ValueError`` is
    not retried.  A request that still fails scores 0.0 with the error as its explanation.
    """
    error: Exception | None = None
    for attempt in range(retries + 1):
        try:
            out = judge(part)
            return pd.DataFrame({
                "key": part["key"].to_numpy(),
                "score": out["score"].astype("float64").to_numpy(),
                "explanation": out["explanation"].to_numpy(),
                "failed": False,
            })
        except Exception as e:  # noqa: BLE001 - any judge error is answered
            error = e
            if isinstance(e, ValueError):
                break
            if attempt < retries:
                time.sleep(delay * (attempt + 1))
    if len(part) > 1:
        half = len(part) // 2
        return pd.concat([call_judge(judge, x, retries, delay) for x in (part.iloc[:half], part.iloc[half:])])
    return pd.DataFrame({
        "key": part["key"].to_numpy(), "score": 0.0,
        "explanation": f"Request failed: {error}", "failed": True,
    })


def judged_by(
    requests: DataFrame, judge: JudgeFn, retries: int = 3, delay: float = 0.5, batch_size: int = 32,
    context: tuple[str, ...] = (), concurrent: int = 8, ledger: str | None = None, parts: int = 200,
) -> DataFrame:
    """Scores of a user-supplied judge, called once per batch inside the tasks.

    The judge gets the key columns and the ``context`` columns (question, problem type, prompt type,
    data source).  Up to ``concurrent`` batches of a task are judged at the same time; errors are handled
    by ``call_judge``.

    ``ledger`` names a shared folder in which every call leaves its answers as soon as they are there.
    Keys are dealt to ``parts`` partitions by hash, so a task that runs again finds the answers of its
    earlier attempts in its own subfolder and asks for the rest only; so does a later job with the same folder and
    number of parts.  Failed requests are asked again.  Without a ledger calls repeat when a lost task reruns.
    """
    check_batch(batch_size)

    def called(part: pd.DataFrame, folder: str | None) -> pd.DataFrame:
        out = call_judge(judge, part, retries, delay)
        good = out[~out["failed"]]
        if folder is not None and len(good):
            attempt = TaskContext.get().attemptNumber()
            add_lines(folder, [{"key": k, "attempt": attempt, "score": float(v), "explanation": e} for k, v, e in zip(good["key"], good["score"], good["explanation"], strict=True)])
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = None if ledger is None else f"{ledger}/{TaskContext.get().partitionId():06d}"
        told = {} if folder is None else {r["key"]: r for r in read_lines(folder)}
        with ThreadPoolExecutor(concurrent) as pool:
            for frame in frames:
                known = frame["key"].isin(told)
                if known.any():
                    rows = [told[k] for k in frame.loc[known, "key"]]
                    yield pd.DataFrame({"key": frame.loc[known, "key"].to_numpy(), "score": [r["score"] for r in rows], "explanation": [r["explanation"] for r in rows], "failed": False})
                frame = frame[~known]
                tasks = [frame.iloc[lo : lo + batch_size] for lo in range(0, len(frame), batch_size)]
                yield from pool.map(called, tasks, [folder] * len(tasks))

    rows = requests.select("key", *KEY_COLUMNS, *context)
    if ledger is not None:
        rows = rows.repartition(parts, "key")
    return rows.mapInPandas(run, "key string, score double, explanation string, failed boolean")


def scored_once(df: DataFrame, score: Callable[[DataFrame], DataFrame] = rule_judged) -> DataFrame:
    """Every request with the score of its key; each key is judged once."""
    keyed = df.withColumn("key", request_key())
    return keyed.join(settled(score(unique_requests(df))), "key", "left")


def cache_lookup(df: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Requests with the score of a cache entry younger than the TTL and a ``hit`` flag.

    ``cache`` holds at most one (key, score, ts) per key; misses keep a null score.
    """
    age = now.cast("double") - F.col("ts").cast("timestamp").cast("double")
    fresh = cache.filter(age < ttl_seconds).select("key", "score", F.lit(True).alias("hit"))
    return (
        df.withColumn("key", request_key()).join(fresh, "key", "left")
        .withColumn("hit", F.coalesce("hit", F.lit(False)))
    )


def cache_misses(df: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """One request per key that has no fresh cache entry."""
    age = now.cast("double") - F.col("ts").cast("timestamp").cast("double")
    return unique_requests(df).join(cache.filter(age < ttl_seconds).select("key"), "key", "left_anti")


def cache_update(cache: DataFrame, scored: DataFrame, max_size: int = 10_000) -> DataFrame:
    """Cache with new (key, score, ts) entries, the latest per key, oldest keys evicted."""
    merged = (
        cache.select("key", "score", "ts").unionByName(scored.select("key", "score", "ts"))
        .groupBy("key").agg(F.max(F.struct("ts", "score")).alias("e"))
        .select("key", "e.score", "e.ts")
    )
    aged = settled(merged.withColumn("_age", -F.unix_micros(F.col("ts").cast("timestamp"))))
    return first_k(aged, ["_age", "key"], max_size).drop("_age")


def request_batches(df: DataFrame, size: int = 32) -> DataFrame:
    """Unique requests with a batch number; every batch but the last holds ``size`` of them."""
    check_batch(size)
    ranked = hash_rank(unique_requests(df), F.col("key"), [], "position")
    return ranked.withColumn("batch", F.floor(F.col("position") / size))


def with_fallback(df: DataFrame, judge: str = "judge_score", rule: str = "rule_reward") -> DataFrame:
    """Judge score where there is one, else the rule reward, with its source.

    An ``explanation`` column, where there is one, says why the judge was passed over.
    """
    if "explanation" in df.columns:
        failed = F.concat(F.lit("Fallback to rule-based reward: "), F.coalesce("explanation", F.lit("")))
        df = df.withColumn(
            "explanation", F.when(F.col(judge).isNull(), failed).otherwise(F.col("explanation"))
        )
    return df.withColumn("score", F.coalesce(judge, rule, F.lit(0.0))).withColumn(
        "source",
        F.when(F.col(judge).isNotNull(), F.lit("judge"))
        .when(F.col(rule).isNotNull(), F.lit("rule_fallback")).otherwise(F.lit("none")),
    )


def judge_metrics(df: DataFrame, batch_size: int = 32) -> DataFrame:
    """Requests, share served by another request's score, batches per request, errors.

    ``df`` holds key and ``failed`` for every request.
    """
    by_key = df.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("failed").cast("int")).alias("bad"))
    total, unique = F.sum("n"), F.count("*")
    batches = F.ceil(unique / batch_size)
    over = lambda a: a / F.greatest(total, F.lit(1))
    return by_key.agg(
        F.coalesce(total, F.lit(0)).alias("total_requests"),
        F.coalesce(over(total - unique), F.lit(0.0)).alias("cache_hit_rate"),
        F.coalesce(over(batches), F.lit(0.0)).alias("batch_rate"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("errors"),
    )

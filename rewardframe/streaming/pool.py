"""Judge pool as a stateful stream operator.

Requests are grouped into buckets by the hash of their key.  The state of a bucket is kept in the state store of the
stream:

* ``scores``, by key: the score and when it was given; entries expire after the TTL.
* ``waiting``: requests whose key has no score yet.
* a timer, set when the first request starts to wait.

A request is answered at once if its cache entry or its key's score is fresh.  The others wait until
enough different keys wait for a full call of the judge, or until the timer fires.  Requests of a key that
already waits wait with it: a key is in one call only.  A failed key is answered but not remembered, so its next
request is judged again.

The work of a micro-batch follows the requests in it, not the scores of before.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.judge import KEY_COLUMNS, call_judge, check_batch

BUCKETS = 64
_SCORE = "score double"
_ANSWER = "request_id {id}, key string, score double, source string, judged boolean, failed boolean, calls int, waited_ms bigint"


class JudgePool(StatefulProcessor):
    """State and calls of a bucket.  ``wait_ms`` 0: nothing waits beyond its micro-batch."""

    def __init__(self, judge: Callable[[pd.DataFrame], pd.DataFrame], fields: str, size: int, wait_ms: int, ttl_ms: int, retries: int, delay: float, concurrent: int):
        check_batch(size)
        self.judge, self.fields, self.size, self.wait_ms, self.ttl_ms = judge, fields, size, wait_ms, ttl_ms
        self.retries, self.delay, self.concurrent = retries, delay, concurrent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scores = handle.getMapState("scores", "key string", _SCORE, self.ttl_ms)
        self.waiting = handle.getListState("waiting", self.fields)
        self.names = [f.split()[0] for f in self.fields.split(", ")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self._held()
        waited = not held.empty
        for frame in rows:
            frame = frame.assign(since=now)[self.names]
            hit = frame["cached_score"].notna()
            if hit.any():
                yield self._answers(frame[hit], frame.loc[hit, "cached_score"], "cache", now)
            frame = frame[~hit]
            told = {k: self.scores.getValue((k,)) for k in frame["key"].unique()}
            score = frame["key"].map(lambda k: told[k][0] if told[k] is not None else None).astype("float64")
            known = score.notna()
            if known.any():
                yield self._answers(frame[known], score[known], "judge", now)
            held = pd.concat([held, frame[~known]]) if not held.empty else frame[~known]
            full = len(held["key"].unique()) // self.size * self.size
            if full:
                yield from self._judged(held, full, now)
                held = self._left(held, full)
        if not held.empty and not self.wait_ms:
            yield from self._judged(held, None, now)
            held = held.iloc[:0]
        if held.empty:
            if waited:
                self.waiting.clear()
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(int(at))
        else:
            self.waiting.put([tuple(r) for r in self._plain(held)])
            if not waited:
                self.handle.registerTimer(now + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        if not held.empty:
            yield from self._judged(held, None, timerValues.getCurrentProcessingTimeInMs())
        self.waiting.clear()

    def close(self) -> None:
        pass

    def _plain(self, held: pd.DataFrame) -> Iterator[list]:
        for row in held.astype(object).itertuples(index=False, name=None):
            yield [None if x is None or x is pd.NaT or x != x else x for x in row]

    def _held(self) -> pd.DataFrame:
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        return pd.DataFrame([tuple(r) for r in rows], columns=self.names)

    def _first(self, held: pd.DataFrame, n: int | None) -> pd.Series:
        return held["key"].isin(held["key"].unique()[:n])

    def _left(self, held: pd.DataFrame, n: int) -> pd.DataFrame:
        return held[~self._first(held, n)]

    def _judged(self, held: pd.DataFrame, n: int | None, now: int) -> Iterator[pd.DataFrame]:
        """Answers of the first ``n`` keys (None: all), in calls of at most ``size`` requests."""
        held = held[self._first(held, n)]
        asked = held.drop_duplicates("key")
        parts = [asked.iloc[lo : lo + self.size] for lo in range(0, len(asked), self.size)]
        with ThreadPoolExecutor(min(self.concurrent, len(parts))) as threads:
            replies = list(threads.map(lambda p: call_judge(self.judge, p, self.retries, self.delay), parts))
        for part, reply in zip(parts, replies, strict=True):
            by_key = reply.set_index("key")
            for key, score, failed in zip(reply["key"], reply["score"], reply["failed"], strict=True):
                if not failed:
                    self.scores.updateValue((key,), (float(score),))
            own = held[held["key"].isin(part["key"])]
            out = self._answers(own, own["key"].map(by_key["score"]), "judge", now)
            out["judged"] = ~own["key"].duplicated().to_numpy()
            out["failed"] = out["judged"] & own["key"].map(by_key["failed"]).to_numpy().astype(bool)
            out["calls"] = [1, *itertools.repeat(0, len(out) - 1)]
            yield out

    def _answers(self, rows: pd.DataFrame, score: pd.Series, source: str, now: int) -> pd.DataFrame:
        return pd.DataFrame({
            "request_id": rows["request_id"].to_numpy(), "key": rows["key"].to_numpy(), "score": score.to_numpy(dtype="float64"), "source": source,
            "judged": False, "failed": False, "calls": 0, "waited_ms": now - rows["since"].to_numpy(dtype="int64"),
        })


def pooled(
    requests: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], request_id: str = "request_id",
    context: tuple[str, ...] = (), size: int = 32, wait_ms: int = 100, ttl_seconds: int = 3600,
    buckets: int = BUCKETS, retries: int = 3, delay: float = 0.5, concurrent: int = 8,
) -> DataFrame:
    """Answers (request_id, key, score, source, judged, failed, calls, waited_ms) of a stream of requests.

    ``requests`` holds the id, ``key``, ``cached_score`` (null: none), the key columns and the ``context``
    columns of the judge.  ``judged`` marks one request per judged key, ``calls`` one row per call.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    fields = {"request_id": kinds[request_id], "key": "string", "cached_score": "double", **{c: kinds[c] for c in (*KEY_COLUMNS, *context)}, "since": "bigint"}
    pool = JudgePool(judge, ", ".join(f"{c} {k}" for c, k in fields.items()), size, wait_ms, ttl_seconds * 1000, retries, delay, concurrent)
    bucket: Column = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    rows = requests.select(bucket.alias("bucket"), F.col(request_id).alias("request_id"), "key", "cached_score", *KEY_COLUMNS, *context)
    return rows.groupBy("bucket").transformWithStateInPandas(pool, _ANSWER.format(id=kinds[request_id]), "append", "ProcessingTime")

"""Stateful streams: attempts until one passes, runs that fall silent, and status rows joined with their heartbeats.

State is kept by key in RocksDB and timers are of event time, so a query that is stopped goes on where it was,
and keys that are done leave little or nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ATTEMPT = "task string, attempt int, outcome string, reason string"
#: A group's open tasks, with the last attempt and the time at which each is given up waiting for, and its decided tasks.
OPEN = "task array<string>, attempt array<int>, reason array<string>, expires array<long>, over array<string>"


def keyed_state(spark: SparkSession) -> None:
    """The store that keyed state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _first_outcomes(most: int, idle_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Counts each task's attempts until one passes, `most` have failed, or none came for `idle_ms`, by groups of tasks."""

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *opened, over = state.getOption or ((), (), (), (), ())
        tasks, over, told = {task: rest for task, *rest in zip(*opened)}, set(over), []
        watermark = state.getCurrentWatermarkMs()
        rows = None if state.hasTimedOut else pd.concat(list(frames)).sort_values("attempt", kind="stable")
        for task, attempt, reason, ms in () if rows is None else zip(*(rows[c].tolist() for c in ("task", "attempt", "reason", "ms"))):
            if task in over:
                continue  # attempts behind the outcome don't count
            attempt, reason = int(attempt), None if reason != reason else reason
            if reason is None or attempt >= most:
                told.append((task, attempt, "accepted" if reason is None else "given_up", reason))
                over.add(task)
                tasks.pop(task, None)
            else:
                tasks[task] = [attempt, reason, max(tasks[task][2] if task in tasks else 0, ms + idle_ms, watermark + 1)]
        for task in [task for task, (*_, expires) in tasks.items() if expires <= watermark]:
            attempt, reason, _ = tasks.pop(task)
            told.append((task, attempt, "timed_out", reason))
            over.add(task)
        state.update((*map(list, zip(*((task, *rest) for task, rest in tasks.items())) if tasks else ((), (), (), ())), list(over)))
        if tasks:  # called again when the watermark is past this time
            state.setTimeoutTimestamp(max(1, min(expires for *_, expires in tasks.values()) - 1))
        if told:
            yield pd.DataFrame(told, columns=["task", "attempt", "outcome", "reason"]).astype({"attempt": "int32"})

    return decide


def attempts(stream: DataFrame, most: int = 3, idle_seconds: int = 3600, late: str = "0 seconds", groups: int = 512) -> DataFrame:
    """task, attempt, outcome, reason: once for each task, when it is decided.

    stream has task, attempt (from 1), reason (null for an attempt that passes) and ts (timestamp). The first attempt that passes is
    accepted; a task is given up at its attempt number `most`, and timed out when the watermark is idle_seconds past its last attempt.
    Attempts of one batch are taken by number. As a call for a key takes milliseconds, keys are `groups` of tasks, a number that a
    checkpoint must keep; a batch rewrites the state of groups that it has rows of, so very many tasks in small batches want more of them.
    """
    keyed_state(stream.sparkSession)
    task = F.col("task").cast("string")
    timed = stream.withWatermark("ts", late).select(F.pmod(F.xxhash64(task), F.lit(groups)).alias("group"), task.alias("task"), "attempt", "reason", "ts", F.unix_millis(F.col("ts")).alias("ms"))
    return timed.groupBy("group").applyInPandasWithState(_first_outcomes(most, idle_seconds * 1000), ATTEMPT, OPEN, "append", GroupStateTimeout.EventTimeTimeout)


class Silence(StatefulProcessor):
    """Tells once when a run has had no event for `after_ms`; a run that speaks again starts anew."""

    def __init__(self, after_ms: int):
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, expires long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, expires = self.last.get() if self.last.exists() else (-1, -1)
        newest = max([last, *(int(f["ms"].max()) for f in rows)])
        if expires >= 0:
            self.handle.deleteTimer(expires)
        expires = max(newest + self.after_ms, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(expires)
        self.last.update((newest, expires))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"run": [str(key[0])], "last_ms": [last], "health": ["stalled"]})


def silent_runs(stream: DataFrame, run: str = "run", ts: str = "ts", after_seconds: int = 1800) -> DataFrame:
    """run, last_ms, health: a row for each run when the watermark is after_seconds past its last event."""
    keyed_state(stream.sparkSession)
    timed = stream.withWatermark(ts, "0 seconds").withColumn("ms", F.unix_millis(F.col(ts).cast("timestamp")))
    return timed.groupBy(run).transformWithStateInPandas(Silence(after_seconds * 1000), "run string, last_ms long, health string", "Append", "EventTime")


def with_heartbeats(status: DataFrame, beats: DataFrame, within: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    """status rows (run, ts, ...) with each heartbeat (run, beat_ts) from ts to `within` behind it, and once, with health `stalled`, where there is none.

    Both sides keep their rows only as long as the interval and the watermarks ask for.
    """
    left = status.withWatermark("ts", late)
    right = beats.select(F.col("run").alias("beat_run"), "beat_ts").withWatermark("beat_ts", late)
    near = (F.col("run") == F.col("beat_run")) & (F.col("beat_ts") >= F.col("ts")) & (F.col("beat_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    joined = left.join(right, near, "leftOuter").drop("beat_run")
    return joined.withColumn("health", F.when(F.col("beat_ts").isNull(), "stalled").otherwise("healthy"))

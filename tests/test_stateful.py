"""Stateful streams against their batch twins, over restarts."""

import datetime
import random

from tessera.streaming import live, stateful

SHAPE = "task string, attempt int, reason string, ts timestamp"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_attempts_over_restarts(spark, tmp_path):
    def arrive(rows):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in")
        live.drain(stateful.attempts(stream, 3, 3600), f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted(tuple(r) for r in spark.read.schema(stateful.ATTEMPT).parquet(f"{tmp_path}/out").collect())

    first = arrive([("a", 1, "bad", at(0)), ("a", 2, None, at(1)), ("b", 1, "bad", at(0)), ("c", 1, "x", at(0)), ("d", 1, "q", at(2))])
    assert first == [("a", 2, "accepted", None)]
    second = arrive([("b", 3, "worse", at(5)), ("b", 2, "w", at(4)), ("a", 3, None, at(6)), ("c", 2, None, at(7)), ("e", 1, "q", at(9))])
    assert second == [("a", 2, "accepted", None), ("b", 3, "given_up", "worse"), ("c", 2, "accepted", None)]
    third = arrive([("z", 1, None, at(65))])  # an hour behind d's only attempt, not yet behind e's
    assert third == sorted([*second, ("d", 1, "timed_out", "q"), ("z", 1, "accepted", None)])
    assert arrive([("d", 2, None, at(66)), ("y", 1, None, at(200))]) == sorted([*third, ("e", 1, "timed_out", "q"), ("y", 1, "accepted", None)])


def test_tasks_share_state_by_group(spark, tmp_path):
    rows = [(f"t{i}", 1, None if i % 3 else "bad", at(i % 7)) for i in range(2000)]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/in")
    query = live.drain(stateful.attempts(spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.schema(stateful.ATTEMPT).parquet(f"{tmp_path}/out").count() == sum(1 for r in rows if r[2] is None)
    assert 0 < query.lastProgress.stateOperators[0].numRowsTotal <= 512  # a row of state for each task takes hours at millions of tasks


def test_attempts_of_groups_are_those_of_single_tasks(spark, tmp_path):
    r, idle, most, watermark, tasks, want = random.Random(5), 40, 3, 0, {}, []

    def expire():
        for task, (attempt, reason, expires) in list(tasks.items()):
            if expires is not None and expires <= watermark:
                want.append((task, attempt, "timed_out", reason))
                tasks[task] = (attempt, reason, None)

    for batch in range(5):
        rows = sorted({(f"t{r.randrange(120)}", r.randrange(1, 5)): (r.choice([None, "x", "y", "z"]), batch * 30 + r.randrange(1, 31)) for _ in range(40)}.items())
        spark.createDataFrame([(t, n, reason, at(m)) for (t, n), (reason, m) in rows], SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.drain(stateful.attempts(spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in"), most, idle * 60, groups=8), f"{tmp_path}/out", f"{tmp_path}/state")
        for (task, n), (reason, minute) in rows:
            attempt, _, expires = tasks.get(task, (0, None, 0))
            if expires is None:
                continue  # decided
            outcome = "accepted" if reason is None else "given_up" if n >= most else None
            tasks[task] = (n, reason, None if outcome else max(expires, minute + idle))
            if outcome:
                want.append((task, n, outcome, reason))
        expire()
        watermark = max(minute for _, (_, minute) in rows)
        expire()
    assert {o for _, _, o, _ in want} == {"accepted", "given_up", "timed_out"}
    key = lambda row: tuple(map(str, row))
    got = [tuple(x) for x in spark.read.schema(stateful.ATTEMPT).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_silent_runs_come_once(spark, tmp_path):
    shape = "run string, ts timestamp"

    def arrive(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.drain(stateful.silent_runs(spark.readStream.schema(shape).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted(r.run for r in spark.read.schema("run string, last_ms long, health string").parquet(f"{tmp_path}/out").collect())

    assert arrive([("a", at(0)), ("b", at(20))]) == []
    assert arrive([("b", at(40))]) == ["a"]
    assert arrive([("a", at(50)), ("b", at(60))]) == ["a"]
    assert arrive([("b", at(100))]) == ["a", "a"]  # it spoke at 50 and fell silent again


def test_status_rows_without_heartbeat_come_once_as_stalled(spark, tmp_path):
    def arrive(statuses, beats):
        spark.createDataFrame(statuses, "run string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
        spark.createDataFrame(beats, "run string, beat_ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/b")
        read = lambda name, shape: spark.readStream.schema(shape).parquet(f"{tmp_path}/{name}")
        joined = stateful.with_heartbeats(read("s", "run string, ts timestamp"), read("b", "run string, beat_ts timestamp"), "30 MINUTES")
        live.drain(joined, f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted((r.run, r.health) for r in spark.read.schema(joined.schema).parquet(f"{tmp_path}/out").collect())

    first = arrive([("a", at(0)), ("b", at(0)), ("c", at(5))], [("a", at(10)), ("c", at(50))])
    assert first == [("a", "healthy")]
    second = arrive([("d", at(200))], [("d", at(210)), ("b", at(100))])
    assert second == [("a", "healthy"), ("b", "stalled"), ("c", "stalled"), ("d", "healthy")]
    assert arrive([("e", at(201))], [("e", at(220))]) == sorted([*second, ("e", "healthy")])

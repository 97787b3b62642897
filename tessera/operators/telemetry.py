"""Run-event analytics: lane summaries and decisions, health, progress, hash chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the lane decisions, which a policy may override one by one.
POLICY = {"min_grpo_steps": 24, "strong_mean_correct_rate": 0.75, "promising_mean_correct_rate": 0.25, "min_mean_format_rate": 0.95, "min_adv_signal_steps": 4, "nonzero_eps": 1.0e-9}


def merged_policy(override: dict | None = None) -> dict:
    return POLICY | (override or {})


def soft_double(column: Column) -> Column:
    return F.coalesce(column.try_cast("double"), F.lit(0.0))


def soft_long(column: Column) -> Column:
    return column.try_cast("bigint")


def lane_summary(events: DataFrame, eps: float = POLICY["nonzero_eps"], lane: str = "lane", order: str = "ord") -> DataFrame:
    """Statistics of each lane's events in one pass; last values are those of the greatest ordinal."""
    step = F.col("event") == "grpo_step"
    value = lambda c: F.when(step, soft_double(F.col(c)))
    mean = lambda c: F.coalesce(F.avg(value(c)), F.lit(0.0))
    top = lambda c: F.coalesce(F.max(value(c)), F.lit(0.0))
    final = lambda c: F.max_by(value(c), F.when(step, F.col(order)))
    return events.groupBy(lane).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.coalesce(F.bool_or(F.col("event") == "run_end"), F.lit(False)).alias("run_end"),
        F.count_if(step).alias("grpo_step_count"),
        F.count_if(F.col("event") == "checkpoint").alias("checkpoint_count"),
        F.max_by("event", order).alias("latest_event"),
        F.max(F.when(step, soft_long(F.col("step")))).alias("latest_grpo_step"),
        F.max(F.when((F.col("event") == "checkpoint") & (F.col("kind") == "final"), soft_long(F.col("step")))).alias("final_checkpoint_step"),
        final("correct_rate").alias("final_correct_rate"),
        final("format_rate").alias("final_format_rate"),
        mean("correct_rate").alias("mean_correct_rate"), top("correct_rate").alias("max_correct_rate"), mean("format_rate").alias("mean_format_rate"),
        mean("reward_mean").alias("mean_reward"), mean("reward_std").alias("mean_reward_std"), top("reward_std").alias("max_reward_std"),
        mean("adv_abs_mean").alias("mean_adv_abs"), top("adv_abs_mean").alias("max_adv_abs"), mean("kl").alias("mean_kl"), top("kl").alias("max_kl"),
        mean("clip_frac").alias("mean_clip_frac"), top("clip_frac").alias("max_clip_frac"),
        F.count_if(F.abs(value("reward_mean")) > eps).alias("nonzero_reward_steps"),
        F.count_if(value("correct_rate") > eps).alias("nonzero_correct_steps"),
        F.count_if(value("adv_abs_mean") > eps).alias("adv_signal_steps"),
        F.count_if(value("reward_std") > eps).alias("reward_std_signal_steps"),
        F.array_sort(F.collect_set(F.when(step & (F.col("prompt_task") != ""), F.col("prompt_task")))).alias("prompt_tasks"),
    )


def lane_decision(summaries: DataFrame, policy: dict | None = None, lane: str = "lane") -> DataFrame:
    """classification, priority and warnings of each lane, most urgent first; a lane without events is `missing`."""
    p = merged_policy(policy)
    final = F.coalesce("final_correct_rate", F.lit(0.0))
    kind = (
        F.when(F.coalesce("event_count", F.lit(0)) == 0, "missing")
        .when((F.col("grpo_step_count") < p["min_grpo_steps"]) | ~F.col("run_end"), "incomplete")
        .when((F.col("max_correct_rate") == 0) & (F.col("nonzero_reward_steps") == 0), "blocked_no_reward_signal")
        .when((F.col("mean_correct_rate") >= p["strong_mean_correct_rate"]) & (final >= p["strong_mean_correct_rate"]), "ready_for_export_eval")
        .when(F.col("mean_correct_rate") >= p["promising_mean_correct_rate"], "promising_but_unstable")
        .otherwise("unstable_sparse_success")
    )
    ranks = {"missing": 0, "blocked_no_reward_signal": 0, "incomplete": 1, "unstable_sparse_success": 1, "promising_but_unstable": 2, "ready_for_export_eval": 3}
    judged = ~F.col("classification").isin("missing", "incomplete")
    notes = F.filter(
        F.array(
            F.when(judged & (F.col("mean_format_rate") < p["min_mean_format_rate"]), "format_rate"),
            F.when(judged & (F.col("adv_signal_steps") < p["min_adv_signal_steps"]), "advantage_signal"),
        ),
        lambda x: x.isNotNull(),
    )
    priority = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))[F.col("classification")]
    return summaries.withColumn("classification", kind).withColumn("priority", priority).withColumn("warnings", notes).orderBy("priority", lane)


def health(state: Column, updated_at: Column, now: float | Column, stall_after: float | Column = 1800.0) -> Column:
    s = F.lower(F.coalesce(state, F.lit("unknown")))
    now = now if isinstance(now, Column) else F.lit(float(now))
    return (
        F.when(s.isin("complete", "completed", "done"), "complete")
        .when(s.isin("failed", "error", "aborted", "crashed"), "failed")
        .when(s.isin("starting", "running") & updated_at.isNotNull(), F.when(now - updated_at > stall_after, "stalled").otherwise("healthy"))
        .otherwise(F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown")))
    )


def progress(done: Column, total: Column, started: Column, updated: Column) -> tuple[Column, Column]:
    """Progress in percent and seconds left, by the rate so far."""
    elapsed = F.greatest(updated - started, F.lit(0.0))
    percent = F.coalesce(F.bround(F.try_divide(done, total) * 100, 3), F.lit(0.0))
    left = F.when((total > 0) & (done > 0) & (done < total) & (elapsed > 0), F.bround(elapsed / done * (total - done), 3)).when((total > 0) & (done >= total), 0.0)
    return percent, left


def step_durations(events: DataFrame, run: str, ts: str = "ts", step: str = "step") -> DataFrame:
    """Seconds a step between consecutive events, where both grow."""
    w = Window.partitionBy(run).orderBy(ts, step)
    d = events.withColumn("d_step", F.col(step) - F.lag(step).over(w)).withColumn("d_ts", F.col(ts) - F.lag(ts).over(w))
    return d.where("d_step > 0 AND d_ts > 0").withColumn("seconds", F.col("d_ts") / F.col("d_step"))


def recent_eta(events: DataFrame, run: str, total_steps: int, now: float, recent: int = 6) -> DataFrame:
    """Seconds left by the mean of the last step durations, less the age of the last step."""
    durations = step_durations(events, run)
    w = Window.partitionBy(run).orderBy(F.desc("ts"), F.desc("step"))
    mean = durations.withColumn("r", F.row_number().over(w)).where(F.col("r") <= recent).groupBy(run).agg(F.avg("seconds").alias("avg_step_sec"))
    last = events.groupBy(run).agg(F.max_by("step", "ts").alias("latest_step"), F.max("ts").alias("latest_ts"))
    left = F.greatest(F.lit(0), total_steps - F.least(F.lit(total_steps), F.col("latest_step") + 1))
    return last.join(mean, run, "left").withColumn("remaining_steps", left).withColumn(
        "eta_sec", F.greatest(F.lit(0.0), left * F.col("avg_step_sec") - F.greatest(F.lit(0.0), F.lit(float(now)) - F.col("latest_ts")))
    )


def chain_hash(ts: Column, action: Column, payload: Column, prev: Column) -> Column:
    """SHA-256 of the event as JSON with sorted keys; ts and payload are given as JSON text."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":|\}$', "")
    return F.sha2(F.concat(F.lit('{"action": '), quoted(action), F.lit(', "payload": '), payload, F.lit(', "prev_hash": '), quoted(prev), F.lit(', "ts": '), ts, F.lit("}")), 256)


def chain_valid(events: DataFrame, log: str = "log", order: str = "ord") -> DataFrame:
    """Whether each log's events link to the event before and hash to what they say."""
    w = Window.partitionBy(log).orderBy(order)
    linked = F.col("prev_hash") == F.coalesce(F.lag("hash").over(w), F.lit(""))
    whole = F.col("hash") == chain_hash(F.col("ts"), F.col("action"), F.col("payload"), F.col("prev_hash"))
    return events.withColumn("ok", linked & whole).groupBy(log).agg(F.bool_and("ok").alias("valid"), F.count(F.lit(1)).alias("events"))


def run_complete(events: DataFrame, total_steps: int, run: str = "run", order: str = "ord") -> DataFrame:
    """Whether the most recent final checkpoint reached the total; step 0 or none counts as -1."""
    final = F.when((F.col("event") == "checkpoint") & (F.col("kind") == "final"), F.col(order))
    step = F.max_by(soft_long(F.col("step")), final)
    return events.groupBy(run).agg(F.coalesce(F.nullif(step, F.lit(0)), F.lit(-1)).alias("final_step")).withColumn("complete", F.col("final_step") >= total_steps)


def training_series(events: DataFrame, run: str = "run") -> DataFrame:
    """run, step and the training values of each step event, by run: train steps, or policy steps in runs that have no train step.

    A value that an event lacks is 0, but tokens_per_sec stays null.
    """
    steps = events.where(F.col("event").isin("train_step", "grpo_step"))
    trained = steps.groupBy(run).agg(F.bool_or(F.col("event") == "train_step").alias("__trained"))
    mine = F.when(F.col("__trained"), "train_step").otherwise("grpo_step")
    zero = ("loss", "lr", "lambda_value", "reward_mean", "correct_rate", "format_rate", "kl", "clip_frac")
    values = [F.coalesce(F.col(c) if c in events.columns else F.lit(None).cast("double"), F.lit(0.0)).alias(c) for c in zero]
    speed = F.col("tokens_per_sec") if "tokens_per_sec" in events.columns else F.lit(None).cast("double").alias("tokens_per_sec")
    return steps.join(trained, run).where(F.col("event") == mine).select(run, "step", speed, *values)


def prefetch_totals(events: DataFrame, group: list[str]) -> DataFrame:
    """bytes_read, reads_completed, avg_mbps and pinned_hit_rate by group; both rates are 0 without time or lookups."""
    sums = events.groupBy(*group).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("bytes_read", "reads_completed", "total_latency_us", "pinned_hits", "pinned_misses")))
    looked = F.col("pinned_hits") + F.col("pinned_misses")
    speed = F.when(F.col("total_latency_us") > 0, F.col("bytes_read") / F.greatest(F.lit(1.0), F.col("total_latency_us") / 1e6) / 1e6).otherwise(0.0)
    return sums.select(*group, "bytes_read", "reads_completed", speed.alias("avg_mbps"), F.when(looked > 0, F.col("pinned_hits") / looked).otherwise(0.0).alias("pinned_hit_rate"))


def layer_times(events: DataFrame, order: str, n: int = 200) -> DataFrame:
    """layer, tier, duration_ms of the last n layer events, in order."""
    rows = events.select(order, F.col("layer_idx").alias("layer"), "tier", (F.coalesce(F.col("duration_us").cast("double"), F.lit(0.0)) / 1000.0).alias("duration_ms"))
    return rows.orderBy(F.desc(order)).limit(n)


def inventory(files: DataFrame, now: float) -> DataFrame:
    """name, length and age in seconds of checkpoint files (path, length, modified), rolling slots and milestones told apart."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.when(name.rlike(r"^(slot|rolling)_"), "rolling").otherwise("milestone")
    return files.select(name.alias("name"), kind.alias("kind"), "length", F.greatest(F.lit(0.0), F.lit(now) - F.col("modified").cast("double")).alias("age_sec"))


def monitor_report(status: DataFrame, heartbeats: DataFrame, summaries: DataFrame, plans: DataFrame, now: float, run: str = "run") -> DataFrame:
    """One row a run that has any of the four: its state, progress, errors, age and health, defaults where a part is missing.

    status and heartbeats have state, updated_at and what a run says of itself; a run without a heartbeat is judged by
    its status. plans has stall_after_sec (0 and null stand for half an hour), summaries total_records and schema_valid_rate.
    """
    as_beat = heartbeats.select(run, F.col("state").alias("beat_state"), F.col("updated_at").alias("beat_at"), F.lit(True).alias("beats"))
    whole = status.join(as_beat, run, "full").join(summaries.select(run, "total_records", "schema_valid_rate"), run, "full").join(plans.select(run, "stall_after_sec"), run, "left")
    after = F.coalesce(F.nullif(F.col("stall_after_sec"), F.lit(0.0)), F.lit(1800.0))
    beat = lambda a, b: F.when(F.col("beats"), F.col(a)).otherwise(F.col(b))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.select(
        run,
        F.coalesce("state", F.lit("unknown")).alias("state"),
        F.coalesce("current_stage", F.lit("-")).alias("current_stage"),
        health(beat("beat_state", "state"), beat("beat_at", "updated_at"), now, after).alias("health"),
        count("processed_tasks"),
        count("total_tasks"),
        F.coalesce("progress_pct", F.lit(0.0)).alias("progress_pct"),
        "eta_sec",
        count("error_count"),
        F.coalesce("last_error", F.lit("")).alias("last_error"),
        "updated_at",
        F.greatest(F.lit(0.0), F.lit(float(now)) - F.coalesce("updated_at", F.lit(float(now)))).alias("age_sec"),
        F.coalesce("total_records", F.lit(0)).cast("long").alias("summary_records"),
        F.coalesce("schema_valid_rate", F.lit(0.0)).alias("schema_valid_rate"),
        after.alias("stall_after_sec"),
    )

"""Queries of run-event analytics over the events table, read as telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import duration_label
from tessera.operators import telemetry as t
from tessera.operators.order import last_n, latest_by
from tessera.plans.base import query
from tessera.session import table

NOW = 1_735_689_600.0
_E = """e AS (SELECT *, epoch(ts)::DOUBLE AS uts, event_id AS ord, event_id // 7 AS step, (event_id % 5) / 5.0 AS rate,
  CASE WHEN event_id % 97 = 0 THEN 'checkpoint' WHEN event_id % 89 = 0 THEN 'run_end' ELSE 'grpo_step' END AS event,
  CASE WHEN event_id % 2 = 0 THEN 'final' ELSE 'rolling' END AS kind, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""


def _events(spark, d):
    i = F.col("event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(
        "*", us.alias("us"), (us / 1e6).alias("uts"), i.alias("ord"), F.floor(i / 7).alias("step"), ((i % 5) / 5.0).alias("rate"),
        F.when(i % 97 == 0, "checkpoint").when(i % 89 == 0, "run_end").otherwise("grpo_step").alias("event"),
        F.when(i % 2 == 0, "final").otherwise("rolling").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def _lanes(spark, d):
    r = F.col("rate")
    return _events(spark, d).select(
        F.col("event_type").alias("lane"), "event", "kind", "ord", "step", r.alias("correct_rate"), F.lit(1.0).alias("format_rate"), (r * 2 - 0.5).alias("reward_mean"),
        (r / 2).alias("reward_std"), (r / 4).alias("adv_abs_mean"), (F.col("value") / 100).alias("kl"), (r / 8).alias("clip_frac"), F.concat(F.lit("task"), F.col("k") % 3).alias("prompt_task"),
    )


@query("latest_per_key", "SELECT event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, d):
    return latest_by(table(spark, d, "events"), ["event_type"], "event_id", ["event_id", "value"]).select("event_type", "event_id", F.round("value", 6).alias("value"))


@query("latest_per_two_keys", "SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_two_keys(spark, d):
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.max("event_id").alias("event_id"))


@query("kind_filter_counts", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def kind_filter_counts(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "view")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("last_events", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def last_events(spark, d):
    return last_n(table(spark, d, "events"), ["ts", "event_id"], 200).select("event_id", "event_type")


@query("event_deltas", """SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER w)::BIGINT AS delta_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def event_deltas(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", (us - F.lag(us).over(w)).alias("delta_us"))


_SUMMARY = f"""WITH {_E}, s AS (SELECT event_type AS lane, event = 'grpo_step' AS g, * FROM e)
SELECT lane, count(*) AS event_count, bool_or(event = 'run_end') AS run_end, count(*) FILTER (g) AS grpo_step_count, count(*) FILTER (event = 'checkpoint') AS checkpoint_count,
  arg_max(event, ord) AS latest_event, max(step) FILTER (g) AS latest_grpo_step, max(step) FILTER (event = 'checkpoint' AND kind = 'final') AS final_checkpoint_step,
  arg_max(rate, ord) FILTER (g) AS final_correct_rate, avg(rate) FILTER (g) AS mean_correct_rate, max(rate) FILTER (g) AS max_correct_rate,
  avg(rate * 2 - 0.5) FILTER (g) AS mean_reward, avg(value / 100) FILTER (g) AS mean_kl, max(value / 100) FILTER (g) AS max_kl,
  count(*) FILTER (g AND abs(rate * 2 - 0.5) > 1e-9) AS nonzero_reward_steps, count(*) FILTER (g AND rate > 1e-9) AS nonzero_correct_steps,
  (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT 'task' || (k % 3) AS x FROM e i WHERE i.event_type = s.lane AND i.event = 'grpo_step')) AS prompt_tasks
FROM s GROUP BY lane"""


@query("lane_summary", f"SELECT lane, event_count, run_end, grpo_step_count, checkpoint_count, latest_event, latest_grpo_step, final_checkpoint_step, round(final_correct_rate, 6) AS final_correct_rate, round(mean_correct_rate, 6) AS mean_correct_rate, round(max_correct_rate, 6) AS max_correct_rate, round(mean_reward, 6) AS mean_reward, round(mean_kl, 6) AS mean_kl, round(max_kl, 6) AS max_kl, nonzero_reward_steps, nonzero_correct_steps, prompt_tasks FROM ({_SUMMARY})")
def lane_summary(spark, d):
    s = t.lane_summary(_lanes(spark, d))
    rounded = {c: F.round(c, 6) for c in ("final_correct_rate", "mean_correct_rate", "max_correct_rate", "mean_reward", "mean_kl", "max_kl")}
    plain = ("lane", "event_count", "run_end", "grpo_step_count", "checkpoint_count", "latest_event", "latest_grpo_step", "final_checkpoint_step", *rounded, "nonzero_reward_steps", "nonzero_correct_steps")
    return s.withColumns(rounded).select(*plain, F.array_join("prompt_tasks", ",").alias("prompt_tasks"))


@query("lane_classify", f"""SELECT lane, CASE WHEN grpo_step_count < 24 OR NOT run_end THEN 'incomplete' WHEN max_correct_rate = 0 AND nonzero_reward_steps = 0 THEN 'blocked_no_reward_signal'
  WHEN mean_correct_rate >= 0.75 AND final_correct_rate >= 0.75 THEN 'ready_for_export_eval' WHEN mean_correct_rate >= 0.25 THEN 'promising_but_unstable' ELSE 'unstable_sparse_success' END AS classification FROM ({_SUMMARY})""")  # fmt: skip
def lane_classify(spark, d):
    return t.lane_decision(t.lane_summary(_lanes(spark, d))).select("lane", "classification")


@query("classification_counts", f"""SELECT classification, count(*) AS n FROM (SELECT CASE WHEN grpo_step_count < 24 OR NOT run_end THEN 'incomplete' WHEN mean_correct_rate >= 0.25 THEN 'promising_but_unstable' ELSE 'unstable_sparse_success' END AS classification FROM ({_SUMMARY})) GROUP BY 1""")
def classification_counts(spark, d):
    return t.lane_decision(t.lane_summary(_lanes(spark, d))).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


_RATE = "CASE c WHEN 2 THEN 0.0 WHEN 3 THEN 0.05 * (event_id % 3) WHEN 4 THEN 0.3 + 0.2 * (event_id % 2) WHEN 5 THEN 0.9 ELSE 0.5 END"


@query("lane_classes", f"""WITH e AS (SELECT event_id, user_id % 24 AS lane, user_id % 24 % 6 AS c, event_type = 'purchase' AS last FROM events), r AS (SELECT *, {_RATE} AS rate FROM e WHERE c > 0),
  s AS (SELECT lane, count(*) FILTER (NOT last) AS steps, bool_or(last AND c <> 1) AS ended, avg(rate) FILTER (NOT last) AS mean, max(rate) FILTER (NOT last) AS most, arg_max(rate, event_id) FILTER (NOT last) AS final FROM r GROUP BY lane)
  SELECT l.lane, CASE WHEN steps IS NULL THEN 'missing' WHEN steps < 24 OR NOT ended THEN 'incomplete' WHEN most = 0 THEN 'blocked_no_reward_signal' WHEN mean >= 0.75 AND final >= 0.75 THEN 'ready_for_export_eval'
    WHEN mean >= 0.25 THEN 'promising_but_unstable' ELSE 'unstable_sparse_success' END AS classification FROM (SELECT DISTINCT lane FROM e) l LEFT JOIN s USING (lane)""")  # fmt: skip
def lane_classes(spark, d):
    """Users in 24 lanes, four of each kind: without events, unended, without reward, with rare, mixed and steady success."""
    lane, last = F.col("user_id") % 24, F.col("event_type") == "purchase"
    e = table(spark, d, "events").select("event_id", lane.alias("lane"), (lane % 6).alias("c"), last.alias("last"))
    kind = F.when(~F.col("last"), "grpo_step").when(F.col("c") != 1, "run_end").otherwise("note")
    empty = {n: F.lit(None).cast("string") for n in ("kind", "prompt_task")} | {n: F.lit(0.0) for n in ("reward_std", "kl", "clip_frac")}
    rate = F.expr(_RATE)
    rows = e.where("c > 0").withColumns({"event": kind, "ord": F.col("event_id"), "step": F.col("event_id"), "correct_rate": rate, "format_rate": F.lit(1.0), "reward_mean": 2 * rate, "adv_abs_mean": rate, **empty})
    summaries = e.select("lane").distinct().join(t.lane_summary(rows), "lane", "left")
    return t.lane_decision(summaries).select("lane", "classification")


@query("eta_overall", f"""WITH {_E}, u AS (SELECT user_id, count(*) AS done, min(uts) AS a, max(uts) AS b FROM e GROUP BY user_id)
  SELECT user_id, round_even(done / 200.0 * 100, 3) AS progress_pct, CASE WHEN done < 200 AND b > a THEN round_even((b - a) / done * (200 - done), 1) WHEN done >= 200 THEN 0.0 END AS eta_sec FROM u""")  # fmt: skip
def eta_overall(spark, d):
    u = _events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("done"), F.min("uts").alias("a"), F.max("uts").alias("b"))
    percent, left = t.progress(F.col("done"), F.lit(200), F.col("a"), F.col("b"))
    return u.select("user_id", percent.alias("progress_pct"), F.bround(left, 1).alias("eta_sec"))


@query("eta_recent", f"""WITH {_E}, x AS (SELECT event_type, uts, step, step - lag(step) OVER w AS ds, uts - lag(uts) OVER w AS dt FROM e WINDOW w AS (PARTITION BY event_type ORDER BY uts, step)),
  r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY uts DESC, step DESC) AS n FROM x WHERE ds > 0 AND dt > 0),
  m AS (SELECT event_type, avg(dt / ds) AS s FROM r WHERE n <= 6 GROUP BY 1), l AS (SELECT event_type, arg_max(step, uts) AS latest_step FROM e GROUP BY 1)
  SELECT event_type, latest_step, round(s, 3) AS avg_step_sec FROM l JOIN m USING (event_type)""")  # fmt: skip
def eta_recent(spark, d):
    rows = _events(spark, d).select("event_type", F.col("uts").alias("ts"), "step")
    return t.recent_eta(rows, "event_type", 10_000, NOW).select("event_type", "latest_step", F.round("avg_step_sec", 3).alias("avg_step_sec"))


@query("stall_health", f"""WITH {_E}, l AS (SELECT user_id, max(uts) AS u, arg_max(event_type, event_id) AS s FROM e GROUP BY 1), m AS (SELECT max(uts) AS now FROM e)
  SELECT user_id, CASE WHEN s = 'error' THEN 'failed' WHEN s = 'purchase' THEN 'complete' WHEN now - u > 1800 THEN 'stalled' ELSE 'healthy' END AS health FROM l, m""")  # fmt: skip
def stall_health(spark, d):
    e = _events(spark, d)
    now = e.agg(F.max("uts")).first()[0]
    last = e.groupBy("user_id").agg(F.max("uts").alias("u"), F.max_by("event_type", "event_id").alias("s"))
    state = F.when(F.col("s") == "error", "failed").when(F.col("s") == "purchase", "done").otherwise("running")
    return last.select("user_id", t.health(state, F.col("u"), now).alias("health"))


@query("histogram", "SELECT json_extract_string(props, '$.k')::BIGINT % 10 AS bucket, count(*) AS n FROM events GROUP BY 1")
def histogram(spark, d):
    return _events(spark, d).groupBy((F.col("k") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("tier_totals", "SELECT event_type AS tier, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS bytes, round(sum(value), 4) AS us, round(sum(json_extract_string(props, '$.k')::BIGINT) / greatest(sum(value), 1e-9), 6) AS mb_per_s FROM events GROUP BY 1")
def tier_totals(spark, d):
    e = _events(spark, d)
    return e.groupBy(F.col("event_type").alias("tier")).agg(F.sum("k").alias("bytes"), F.round(F.sum("value"), 4).alias("us"), F.round(F.sum("k") / F.greatest(F.sum("value"), F.lit(1e-9)), 6).alias("mb_per_s"))


@query("training_series", """SELECT event_id // 7 AS step, round(avg(value), 6) AS loss, round(0.001 * least(1.0, (event_id // 7 + 1) / 100.0), 9) AS lr FROM events GROUP BY event_id // 7""")
def training_series(spark, d):
    step = F.col("step")
    return _events(spark, d).groupBy("step").agg(F.round(F.avg("value"), 6).alias("loss")).withColumn("lr", F.round(0.001 * F.least(F.lit(1.0), (step + 1) / 100.0), 9))


@query("duration_labels", """WITH s AS (SELECT user_id, round_even(round(sum(value), 6), 0)::BIGINT AS s FROM events GROUP BY 1) SELECT user_id,
  CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm' END AS label FROM s""")  # fmt: skip
def duration_labels(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("s")).select("user_id", duration_label(F.col("s")).alias("label"))


@query("run_complete", f"""WITH {_E}, c AS (SELECT user_id AS run, arg_max(step, ord) FILTER (event = 'checkpoint' AND kind = 'final') AS s FROM e GROUP BY 1)
  SELECT run, coalesce(nullif(s, 0), -1) AS final_step, coalesce(nullif(s, 0), -1) >= 500 AS complete FROM c""")  # fmt: skip
def run_complete(spark, d):
    return t.run_complete(_events(spark, d).withColumnRenamed("user_id", "run"), 500)


_LINK = "sha256('{\"action\": \"' || event_type || '\", \"payload\": ' || props || ', \"prev_hash\": \"' || PREV || '\", \"ts\": ' || event_id || '}')"


@query("hash_chain", f"""WITH a AS (SELECT event_id // 2 AS log, event_id AS ord, event_type, props, event_id, {_LINK.replace('PREV', "''")} AS h FROM events),
  b AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY log ORDER BY ord), '') AS before FROM a),
  c AS (SELECT *, {_LINK.replace('PREV', 'before')} AS hash, CASE WHEN log % 3 = 1 AND before <> '' THEN 'x' ELSE before END AS prev, CASE WHEN log % 3 = 2 THEN '{{}}' ELSE props END AS seen FROM b)
  SELECT log, count(*) AS events, bool_and(prev = before AND seen = props) AS valid FROM c GROUP BY log""")  # fmt: skip
def hash_chain(spark, d):
    """Logs of two events: a third is whole, in a third a link is cut, and in a third the payloads were changed afterwards."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("log"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("ts"), F.col("event_type").alias("action"), F.col("props").alias("payload"))
    link = lambda prev: t.chain_hash(F.col("ts"), F.col("action"), F.col("payload"), prev)
    before = F.coalesce(F.lag("first").over(Window.partitionBy("log").orderBy("ord")), F.lit(""))
    linked = e.withColumn("first", link(F.lit(""))).withColumn("before", before).withColumn("hash", link(F.col("before")))
    kind = F.col("log") % 3
    spoilt = linked.withColumn("prev_hash", F.when((kind == 1) & (F.col("before") != ""), "x").otherwise(F.col("before"))).withColumn("payload", F.when(kind == 2, "{}").otherwise(F.col("payload")))
    return t.chain_valid(spoilt).select("log", "events", "valid")


@query("chain_hashes", f"SELECT event_id, {_LINK.replace('PREV', 'props_prev')} AS hash FROM (SELECT *, 'p' || user_id AS props_prev FROM events)")
def chain_hashes(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", t.chain_hash(F.col("event_id").cast("string"), F.col("event_type"), F.col("props"), F.concat(F.lit("p"), F.col("user_id"))).alias("hash"))


@query("stage_fill", """WITH s AS (SELECT DISTINCT n_name AS stage FROM nation), e AS (SELECT user_id % 25 AS nk, event_type, event_id FROM events),
  l AS (SELECT n.n_name AS stage, arg_max(event_type, event_id) AS status FROM e JOIN nation n ON n.n_nationkey = e.nk GROUP BY 1)
  SELECT stage, coalesce(status, 'marker') AS status FROM s LEFT JOIN l USING (stage)""")  # fmt: skip
def stage_fill(spark, d):
    """Latest status of each stage, filled where it has no event; the dimension is small by itself."""
    nation = table(spark, d, "nation").select(F.col("n_name").alias("stage"), F.col("n_nationkey").alias("nk"))
    e = table(spark, d, "events").groupBy((F.col("user_id") % 25).alias("nk")).agg(F.max_by("event_type", "event_id").alias("status"))
    return nation.join(e, "nk", "left").select("stage", F.coalesce("status", F.lit("marker")).alias("status"))


@query("dimension_lookup", "SELECT r_name AS lane, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def dimension_lookup(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("lane")).agg(F.count(F.lit(1)).alias("n"))


@query("stage_counts", "SELECT count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events")
def stage_counts(spark, d):
    return table(spark, d, "events").agg(F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("monitor_report", f"""WITH {_E}, r AS (SELECT user_id AS run, count(*) AS n, max(uts) AS u, arg_max(event_type, event_id) AS s, count(*) FILTER (event_type = 'error') AS errors, max(uts) FILTER (event_type = 'click') AS beat FROM e GROUP BY 1), m AS (SELECT max(uts) AS now FROM e),
  k AS (SELECT *, user_id_mod FROM (SELECT *, run % 4 AS user_id_mod FROM r)), a AS (SELECT *, CASE WHEN user_id_mod = 1 THEN 86400.0 ELSE 1800.0 END AS after_, CASE WHEN beat IS NOT NULL AND run % 3 > 0 THEN beat ELSE u END AS last FROM k)
  SELECT run, CASE s WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'running' END AS state, n AS processed_tasks, round(100.0 * n / 1000, 6) AS progress_pct, errors AS error_count, round(now - u, 3) AS age_sec, CASE WHEN run % 2 = 0 THEN n ELSE 0 END AS summary_records, after_ AS stall_after_sec,
    CASE WHEN beat IS NOT NULL AND run % 3 > 0 THEN CASE WHEN now - beat > after_ THEN 'stalled' ELSE 'healthy' END WHEN s = 'error' THEN 'failed' WHEN s = 'purchase' THEN 'complete' WHEN now - u > after_ THEN 'stalled' ELSE 'healthy' END AS health FROM a, m""")  # fmt: skip
def monitor_report(spark, d):
    """Users as runs: status from all events, heartbeats from the clicks of two in three users, summaries for every second, plans for every fourth."""
    e, run = _events(spark, d).withColumn("run", F.col("user_id")), F.col("user_id")
    now = e.agg(F.max("uts")).first()[0]
    last = e.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("uts").alias("updated_at"), F.max_by("event_type", "event_id").alias("s"), F.count_if(F.col("event_type") == "error").alias("error_count"))
    state = F.when(F.col("s") == "error", "failed").when(F.col("s") == "purchase", "done").otherwise("running")
    status = last.select("run", state.alias("state"), F.lit(None).cast("string").alias("current_stage"), F.col("n").alias("processed_tasks"), F.lit(1000).alias("total_tasks"), (F.col("n") / 10).alias("progress_pct"), F.lit(None).cast("double").alias("eta_sec"), "error_count", F.lit(None).cast("string").alias("last_error"), "updated_at")
    beats = e.where((F.col("event_type") == "click") & (run % 3 > 0)).groupBy("run").agg(F.max("uts").alias("updated_at")).withColumn("state", F.lit("running"))
    summaries = last.where(F.col("run") % 2 == 0).select("run", F.col("n").alias("total_records"), F.lit(1.0).alias("schema_valid_rate"))
    plans = last.where(F.col("run") % 4 == 1).select("run", F.lit(86400.0).alias("stall_after_sec"))
    report = t.monitor_report(status, beats, summaries, plans, now)
    return report.select("run", "state", "health", "processed_tasks", F.round("progress_pct", 6).alias("progress_pct"), "error_count", F.round("age_sec", 3).alias("age_sec"), "summary_records", "stall_after_sec")

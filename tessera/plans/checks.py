"""Queries of bundle checks, guards, training panels and reward composition."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import checks as C
from tessera.operators import telemetry as t
from tessera.plans.base import query
from tessera.session import table

_B = """b AS (SELECT lang, left(text, 40) AS prompt, text, CASE WHEN doc_id % 50 = 0 THEN 'x return None' WHEN doc_id % 50 = 1 THEN '{"arguments": {}}' WHEN doc_id % 50 = 2 THEN '<answer>0</answer>' ELSE source END AS response, source AS reference FROM documents)"""


def _bundle(spark, d, every=50):
    i = F.col("doc_id") % every
    response = F.when(i == 0, "x return None").when(i == 1, '{"arguments": {}}').when(i == 2, "<answer>0</answer>").otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", "lang", F.substring("text", 1, 40).alias("prompt"), "text", response.alias("response"), F.col("source").alias("reference"))


@query("bundle_heuristics", f"""WITH {_B} SELECT count(*) AS total_records, count(DISTINCT coalesce(prompt, '')) AS unique_prompts, count(DISTINCT coalesce(text, '')) AS unique_texts,
  (count(*) FILTER (contains(response, 'return None')) + count(*) FILTER (contains(text, 'return None')))::BIGINT AS fallback_return_none, count(*) FILTER (contains(response, '<answer>0</answer>')) AS answer_zero_count,
  count(*) FILTER (contains(prompt, 'A. Option A') AND contains(prompt, 'B. Option B')) AS placeholder_choice_count, (count(*) FILTER (contains(response, '"arguments": {{}}')) + count(*) FILTER (contains(text, '"arguments": {{}}')))::BIGINT AS empty_arguments_count,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM b GROUP BY reference)) AS most_one_reference FROM b""")  # fmt: skip
def bundle_heuristics(spark, d):
    return C.bundle_heuristics(_bundle(spark, d))


_COUNTS = """c AS (SELECT lang, count(*) AS n, count(DISTINCT coalesce(prompt, '')) AS p, count(DISTINCT coalesce(text, '')) AS t, count(*) FILTER (contains(response, 'return None') OR contains(text, 'return None')) AS none, count(*) FILTER (contains(response, '<answer>0</answer>')) AS zero,
  count(*) FILTER (contains(response, '"arguments": {}') OR contains(text, '"arguments": {}')) AS empty, count(*) FILTER (contains(prompt, 'A. Option A')) AS options FROM b GROUP BY lang),
  m AS (SELECT lang, max(k) AS most FROM (SELECT lang, reference, count(*) AS k FROM b GROUP BY ALL) GROUP BY lang)"""


@query("heuristic_gate", f"""WITH {_B.replace("doc_id % 50", "doc_id % 150")}, {_COUNTS} SELECT lang, lane, concat_ws('; ',
  CASE WHEN lane = 'code' AND none > 0 THEN 'code fallback `def solve(): return None` records detected' WHEN lane = 'math' AND zero > 0 THEN 'math fallback `<answer>0</answer>` records detected' WHEN lane = 'stem_reasoning' AND options > 0 THEN 'stem placeholder `Option A/B/C/D` choices detected' WHEN lane = 'tool_use' AND empty > 0 THEN 'tool-use empty `arguments: {{}}` records detected' END,
  CASE WHEN (n - p) / n > 0.5 THEN 'duplicate prompt ratio exceeds 50%' END, CASE WHEN (n - t) / n > 0.5 THEN 'duplicate text ratio exceeds 50%' END,
  CASE WHEN most / n > 0.75 AND lane <> 'code' THEN 'reference label/value skew exceeds 75%' END) AS reason FROM c JOIN m USING (lang), (VALUES ('code'), ('math'), ('stem_reasoning'), ('tool_use')) v(lane)""")  # fmt: skip
def heuristic_gate(spark, d):
    """The reasons of each lane over each language's rows, of which few are fallbacks."""
    rows, parts = _bundle(spark, d, 150), []
    for lang in [r["lang"] for r in rows.select("lang").distinct().collect()]:  # a row a language
        counts = C.bundle_heuristics(rows.where(F.col("lang") == lang))
        parts += [C.heuristic_gate(counts, lane).select(F.lit(lang).alias("lang"), F.lit(lane).alias("lane"), F.array_join("reasons", "; ").alias("reason")) for lane in C.LANE_REASONS]
    return functools.reduce(DataFrame.unionByName, parts)


@query("fetch_gate", "SELECT count(*) AS sources, count(*) FILTER (n >= 50) AS sampled_sources, count(*) FILTER (n < 50) AS failed_sources FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def fetch_gate(spark, d):
    sources = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return C.fetch_gate(sources.withColumn("status", F.when(F.col("n") >= 50, "sampled").otherwise("error")), 1)


@query("reset_guard", """WITH f AS (SELECT source AS run, array_to_string(list_sort(list(DISTINCT lang) FILTER (length(text) > 4000)), ', ') AS f FROM documents GROUP BY source),
  s AS (SELECT source AS run, count(*) FILTER (doc_id % 97 = 0) AS s FROM documents GROUP BY source), t AS (SELECT source AS run, count(*) FILTER (doc_id % 101 = 1) + count(*) FILTER (doc_id % 103 = 2) AS r, count(*) FILTER (doc_id % 107 = 3) AS p FROM documents GROUP BY source),
  k AS (SELECT run, max(r) AS cr, max(p) AS cp FROM (SELECT source AS run, lang, count(*) FILTER (doc_id % 109 = 4) AS r, count(*) FILTER (doc_id % 113 = 5) AS p FROM documents GROUP BY ALL) GROUP BY run),
  e AS (SELECT run, concat_ws('; ', 'non-empty artifacts: ' || nullif(f, ''), CASE WHEN s > 0 THEN 'eval_summary.json reports ' || s || ' records' END, CASE WHEN r > 0 OR p > 0 THEN 'status.json reports ' || p || ' processed tasks and ' || r || ' records' END,
    CASE WHEN cr > 0 OR cp > 0 THEN 'checkpoint_*.json reports up to ' || cp || ' processed tasks and ' || cr || ' records' END) AS reasons FROM f JOIN s USING (run) JOIN t USING (run) JOIN k USING (run)) SELECT run, reasons, reasons = '' AS may_reset FROM e""")  # fmt: skip
def reset_guard(spark, d):
    """Sources as runs: languages with long texts as artifacts, and rare documents as the records that summaries, statuses and checkpoints tell of."""
    docs = table(spark, d, "documents").withColumnRenamed("source", "run")
    of = lambda n, rest: F.count_if(F.col("doc_id") % n == rest)
    artifacts = docs.groupBy("run", F.col("lang").alias("name")).agg(F.count_if(F.char_length("text") > 4000).alias("size"))
    summaries = docs.groupBy("run").agg(of(97, 0).alias("total_records"))
    statuses = docs.groupBy("run").agg(of(101, 1).alias("train_records"), of(103, 2).alias("val_records"), of(107, 3).alias("processed_tasks"))
    checkpoints = docs.groupBy("run", "lang").agg(of(109, 4).alias("train_records"), F.lit(0).alias("val_records"), of(113, 5).alias("processed_tasks_total"))
    return C.reset_guard(artifacts, summaries, statuses, checkpoints)


@query("chosen_stages", "SELECT DISTINCT n_name AS stage FROM nation WHERE (contains(n_name, '_1') OR contains(n_name, '3')) AND NOT contains(n_name, '12') AND NOT contains(n_name, '_3')")
def chosen_stages(spark, d):
    return C.chosen_stages(table(spark, d, "nation").select(F.col("n_name").alias("stage")).distinct(), "_1,3", "12,_3")


@query("first_present", "SELECT user_id, arg_min(event_type, event_id) FILTER (value > 10) AS path FROM events GROUP BY user_id")
def first_present(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("priority"), F.col("event_type").alias("path"), F.when(F.col("value") > 10, 1).otherwise(0).alias("length"))
    return C.first_present(rows, ["user_id"])


@query("training_panel", """WITH s AS (SELECT user_id AS run, event_id AS step, event_type, value FROM events WHERE event_type IN ('click', 'view')), m AS (SELECT run, bool_or(event_type = 'click') AS trained FROM s GROUP BY 1)
  SELECT run, step, round(coalesce(CASE WHEN event_type = 'click' THEN value END, 0.0), 6) AS loss, round(coalesce(CASE WHEN event_type = 'view' THEN value END, 0.0), 6) AS kl FROM s JOIN m USING (run) WHERE event_type = CASE WHEN trained THEN 'click' ELSE 'view' END""")  # fmt: skip
def training_panel(spark, d):
    """Clicks as train steps with a loss, views as policy steps with a divergence."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "train_step").when(F.col("event_type") == "view", "grpo_step").otherwise("other")
    rows = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), kind.alias("event"), F.when(F.col("event_type") == "click", F.col("value")).alias("loss"), F.when(F.col("event_type") == "view", F.col("value")).alias("kl"))
    return t.training_series(rows).select("run", "step", F.round("loss", 6).alias("loss"), F.round("kl", 6).alias("kl"))


@query("prefetch_totals", """SELECT event_type AS tier, sum(event_id)::BIGINT AS bytes_read, count(*) AS reads_completed, round(CASE WHEN sum(value) > 0 THEN sum(event_id) / greatest(1.0, sum(value) / 1e6) / 1e6 ELSE 0 END, 6) AS avg_mbps,
  round(avg((user_id % 3 = 0)::INT), 6) AS pinned_hit_rate FROM events GROUP BY 1""")  # fmt: skip
def prefetch_totals(spark, d):
    hit = (F.col("user_id") % 3 == 0).cast("int")
    e = table(spark, d, "events").select(F.col("event_type").alias("tier"), F.col("event_id").alias("bytes_read"), F.lit(1).alias("reads_completed"), F.col("value").alias("total_latency_us"), hit.alias("pinned_hits"), (1 - hit).alias("pinned_misses"))
    return t.prefetch_totals(e, ["tier"]).withColumns({"avg_mbps": F.round("avg_mbps", 6), "pinned_hit_rate": F.round("pinned_hit_rate", 6)})


@query("layer_times", "SELECT event_id, user_id % 12 AS layer, event_type AS tier, round(value / 1000.0, 6) AS duration_ms FROM events ORDER BY event_id DESC LIMIT 200")
def layer_times(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 12).alias("layer_idx"), F.col("event_type").alias("tier"), F.col("value").alias("duration_us"))
    return t.layer_times(e, "event_id").withColumn("duration_ms", F.round("duration_ms", 6))


@query("reward_groups", """SELECT user_id AS step, round(avg(value), 6) AS reward_mean, round(stddev_pop(value), 6) AS reward_std, round(avg((event_type = 'purchase')::INT), 6) AS correct_rate, round(avg((event_type <> 'error')::INT), 6) AS format_rate FROM events GROUP BY 1""")
def reward_groups(spark, d):
    """Rewards of a rollout group by step, with the shares that are right and well formed."""
    from tessera.operators.statistics import reward_composition

    e = table(spark, d, "events").select(F.col("user_id").alias("step"), F.col("value").alias("reward"), (F.col("event_type") == "purchase").cast("double").alias("correct"), (F.col("event_type") != "error").cast("double").alias("format"))
    return reward_composition(e, ["step"]).select("step", *(F.round(c, 6).alias(c) for c in ("reward_mean", "reward_std", "correct_rate", "format_rate")))


@query("clip_fraction", "SELECT user_id, round(avg(m), 6) AS clip_frac FROM (SELECT user_id, (abs(value / 20 - 1) > 0.2)::INT AS m FROM events) GROUP BY user_id")
def clip_fraction(spark, d):
    from tessera.operators.statistics import clip_fraction as fraction

    e = table(spark, d, "events").select("user_id", (F.col("value") / 20).alias("ratio"), F.lit(1).alias("mask"))
    return fraction(e, ["user_id"], "ratio", "mask", 0.2).withColumn("clip_frac", F.round("clip_frac", 6))

"""Queries of bundle summaries, gates and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import verifiers as V
from tessera.operators import bundles as B
from tessera.operators import generators as G
from tessera.plans.base import query
from tessera.session import table

_R = """r AS (SELECT doc_id, left(text, 60) AS prompt, text, source, lang, length(text) >= 64 AS valid, CASE WHEN doc_id % 3 <> 0 THEN (length(text) > 300)::INT END AS score FROM documents),
 s AS (SELECT count(*) AS total_records, count(*) FILTER (valid) AS valid_json_records, count(*) - count(DISTINCT text) AS exact_duplicate_count, count(*) - count(DISTINCT prompt) AS duplicate_prompt_count,
 count(DISTINCT lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))) AS u, count(score) AS verifier_total, count(*) FILTER (score >= 1) AS verifier_pass_count FROM r)"""
_RATES = "round(valid_json_records / total_records, 6) AS schema_valid_rate, round(u / total_records, 6) AS unique_text_ratio, round(exact_duplicate_count / total_records, 6) AS exact_duplicate_ratio, round(verifier_pass_count / verifier_total, 6) AS verifier_pass_rate"


def _records(spark, d):
    t, n = F.col("text"), F.char_length("text")
    return table(spark, d, "documents").select("doc_id", F.substring(t, 1, 60).alias("prompt"), "text", "source", "lang", (n >= 64).alias("valid"), F.when(F.col("doc_id") % 3 != 0, (n > 300).cast("int")).alias("score"))


@query("bundle_summary", f"WITH {_R} SELECT total_records, valid_json_records, exact_duplicate_count, duplicate_prompt_count, verifier_total, verifier_pass_count, {_RATES} FROM s")
def bundle_summary(spark, d):
    s = B.bundle_summary(_records(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("schema_valid_rate", "unique_text_ratio", "exact_duplicate_ratio", "verifier_pass_rate")})


@query("bundle_histograms", f"WITH {_R} SELECT 'source' AS dimension, source AS value, count(*) AS n FROM r GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM r GROUP BY lang UNION ALL SELECT 'valid', valid::VARCHAR, count(*) FROM r GROUP BY valid")
def bundle_histograms(spark, d):
    return B.histograms(_records(spark, d), ["source", "lang", "valid"])


@query("quality_gate", f"""WITH {_R} SELECT array_to_string(list_filter([CASE WHEN valid_json_records / total_records < 0.98 THEN 'schema_valid_rate' END, CASE WHEN u / total_records < 0.95 THEN 'unique_text_ratio' END,
  CASE WHEN exact_duplicate_count > 0 THEN 'exact_duplicate_ratio' END, CASE WHEN verifier_pass_count / verifier_total < 0.85 THEN 'verifier_pass_rate' END], lambda x: x IS NOT NULL), ',') AS failures FROM s""")  # fmt: skip
def quality_gate(spark, d):
    return B.gate_failures(B.bundle_summary(_records(spark, d))).select(F.array_join("failures", ",").alias("failures"))


@query("dup_excess", "SELECT source, count(*) - count(DISTINCT text) AS excess FROM documents GROUP BY source")
def dup_excess(spark, d):
    return table(spark, d, "documents").groupBy("source").agg((F.count(F.lit(1)) - F.countDistinct("text")).alias("excess"))


@query("unique_ratio", "SELECT lang, round(count(DISTINCT lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))) / count(*), 6) AS ratio FROM documents GROUP BY lang")
def unique_ratio(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.countDistinct(F.sha1(T.fingerprint(F.col("text")))) / F.count(F.lit(1)), 6).alias("ratio"))


_FP = "lower(regexp_replace(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))"


def walked(rows: str) -> str:
    """SQL: a walk over rows (n from 1, doc_id, t, p, reason) that keeps lists of the texts and prompts accepted so far; walk has doc_id and reason."""
    empty = "{'ts': []::UBIGINT[], 'ps': []::UBIGINT[], 'out': []::VARCHAR[]}"
    told = "CASE WHEN x.reason IS NOT NULL THEN x.reason WHEN list_contains(seen.ts, x.t) THEN 'duplicate_text' WHEN list_contains(seen.ps, x.p) THEN 'duplicate_prompt' ELSE '' END"
    step = f"{{'ts': CASE WHEN {told} = '' THEN list_append(seen.ts, x.t) ELSE seen.ts END, 'ps': CASE WHEN {told} = '' THEN list_append(seen.ps, x.p) ELSE seen.ps END, 'out': list_append(seen.out, {told})}}"
    return f"""rows AS MATERIALIZED ({rows}),
  walked AS (SELECT list_reduce(list({{'t': t, 'p': p, 'reason': reason}} ORDER BY n), lambda seen, x: {step}, {empty}).out AS out FROM rows),
  walk AS (SELECT doc_id, nullif(out[n], '') AS reason FROM rows, walked)"""


@query("reject_duplicates", f"""WITH {_R}, {walked(f"SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, hash({_FP.format('text')}) AS t, hash({_FP.format('prompt')}) AS p, CASE WHEN NOT valid THEN 'too_short_response' END AS reason FROM r")}
  SELECT doc_id, reason FROM walk""")  # fmt: skip
def reject_duplicates(spark, d):
    rows = _records(spark, d).select("doc_id", "prompt", "text", F.when(~F.col("valid"), "too_short_response").alias("reason"))
    return B.reject_duplicates(rows, "doc_id").select("doc_id", "reason")


@query("ordered_acceptance", f"""WITH {walked("SELECT row_number() OVER (ORDER BY md5(event_id::VARCHAR), event_id) AS n, event_id AS doc_id, hash(user_id) AS t, hash(event_type || date_trunc('hour', ts)::VARCHAR) AS p, NULL::VARCHAR AS reason FROM events")}
  SELECT doc_id AS event_id, reason FROM walk""")  # fmt: skip
def ordered_acceptance(spark, d):
    """Events in random order as records that share users and hours in long alternating chains."""
    key = F.concat(F.md5(F.col("event_id").cast("string")), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, d, "events").select(key.alias("ord"), F.col("user_id").cast("string").alias("text"), F.concat("event_type", hour).alias("prompt"), F.lit(None).cast("string").alias("reason"))
    return B.reject_duplicates(rows, "ord").select(F.substring("ord", 33, 20).cast("long").alias("event_id"), "reason")


@query("common_reasons", """SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < [1, 48, 32, 40, 16][(doc_id % 5 + 1)::INT] THEN 'too_short_response'
  WHEN length(source) < [1, 12, 1, 1, 16][(doc_id % 5 + 1)::INT] THEN 'too_short_reference' END AS reason FROM documents""")  # fmt: skip
def common_reasons(spark, d):
    lane = F.element_at(F.array(*map(F.lit, B.LANES)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", B.common_reason(lane, F.col("text"), F.col("source"), F.lit("")).alias("reason"))


@query("zero_answers", "SELECT event_id, abs(floor(value) - 3) < 1 AND floor(value) = 3 AS zero FROM events")
def zero_answers(spark, d):
    answer = F.concat((F.floor("value") - 3).cast("string"), F.lit(".00."))
    return table(spark, d, "events").select("event_id", B.zero_answer(answer).alias("zero"))


@query("tool_rules", """SELECT event_id, ['empty_tool_arguments', 'generic_tool_name', 'non_mcp_agent_tool_name', 'non_concrete_tool_arguments', 'destructive_tool_arguments', 'verifier_failed_tool_json', NULL][(event_id % 7 + 1)::INT] AS reason FROM events""")
def tool_rules(spark, d):
    k = (F.col("event_id") % 7 + 1).cast("int")
    pick = lambda *options: F.element_at(F.array(*map(F.lit, options)), k)
    good = '{"path": "a"}'
    name = pick("mcp.x", "tool.call", "web.get", "mcp.x", "agent.y", "mcp.x", "mcp.x")
    arguments = pick("{}", good, good, '{"path": " "}', '{"cmd": "rm -rf /tmp/x"}', good, good)
    response = pick("{}", "{}", "{}", "{}", "{}", "{", '{"arguments": {"path": "a"}}')
    return table(spark, d, "events").select("event_id", B.tool_reason(name, arguments, response, F.lit('{"arguments":{"path":"a"}}')).alias("reason"))


@query("code_rules", """SELECT item_id, ['fallback_code_stub', 'missing_typed_public_callable', 'missing_assert_verifier', 'non_executing_assert_verifier', 'verifier_redefines_candidate_api', 'callable_only_verifier', NULL][(item_id % 7 + 1)::INT] AS reason FROM benchmark""")
def code_rules(spark, d):
    k = (F.col("item_id") % 7 + 1).cast("int")
    pick = lambda *options: F.element_at(F.array(*map(F.lit, options)), k)
    good, check = "def add(a: int, b: int) -> int:\n    return a + b\n", "assert add(1, 2) == 3"
    code = pick("def f():\n    return None", "def add(a, b):\n    return a + b", good, good, good, good, good)
    verifier = pick(check, check, "add(1, 2)", f"def test_it():\n    {check}", f"def add(a, b):\n    return 3\n{check}", "assert callable(add)", check)
    return table(spark, d, "benchmark").select("item_id", B.code_reason(code, verifier, F.lit("python"), F.lit("python_exec"), code, verifier).alias("reason"))


@query("failure_contrast", """SELECT 2 * count(*) AS failures, round((count(*) + count(*) FILTER (item_id % 5 <> 0)) / (2.0 * count(*)), 6) AS expected_zero_rate FROM benchmark""")
def failure_contrast(spark, d):
    """Two bad answers of each item, scored; the share that scores 0 as it should. Every fifth item's second answer isn't bad."""
    i = F.col("item_id")
    off = (F.lit(1), i % 5)
    bad = F.array(*(F.struct(F.concat(F.lit("<think>guessing here</think><answer>"), (i + k).cast("string"), F.lit("</answer>")).alias("bad_response"), F.lit(label).alias("label")) for k, label in zip(off, ("off_by_one", "off_by_rest"), strict=True)))
    score = V.exact_math(F.col("bad_response"), i.cast("string"))
    rows = B.failure_contrast(table(spark, d, "benchmark").select("item_id"), bad, score)
    return rows.agg(F.count(F.lit(1)).alias("failures"), F.round(F.avg((F.col("observed_score") == 0).cast("double")), 6).alias("expected_zero_rate"))


@query("generated_bundle", """WITH n AS (SELECT count(*) AS n FROM benchmark)
  SELECT lane, n AS records, round(1 - ((n + 3) // 7) / n, 6) AS pass_rate, (n + 9) // 10 AS val FROM n, (VALUES ('math'), ('tool_use')) l(lane)""")  # fmt: skip
def generated_bundle(spark, d):
    """As many records a lane as there are items, every seventh with a reference that its response misses: pass rate, and the tenth that is validation."""
    n, out = table(spark, d, "benchmark").count(), None
    for lane, verifier in (("math", V.exact_math), ("tool_use", V.json_match)):
        spoilt = F.when(F.col("idx") % 7 == 3, F.lit('["other"]')).otherwise(F.col("reference"))
        rows = G.as_records(G.generate(spark, lane, n)).withColumn("score", verifier(F.col("response"), spoilt))
        one = rows.agg(F.lit(lane).alias("lane"), F.count(F.lit(1)).alias("records"), F.round(F.avg("score"), 6).alias("pass_rate"), F.count_if(F.col("idx") % 10 == 0).alias("val"))
        out = one if out is None else out.unionByName(one)
    return out


_OK = "bool_and(records >= 10 AND rate >= 1 AND duplicates = 0)"


@query("stage_gate", f"""WITH l AS (SELECT lang, count(*) AS records, count(*) - count(DISTINCT text) AS duplicates, avg((length(text) > 0)::INT) AS rate FROM documents GROUP BY 1),
  u AS (SELECT lang, count(*) AS records, 0 AS duplicates, 1.0 AS rate FROM (SELECT DISTINCT lang, text FROM documents WHERE length(text) > 0) GROUP BY 1)
  SELECT 'all' AS input, count(*) AS lanes, {_OK} AS all_ok, count(*) >= 4 AND {_OK} AS skip FROM l UNION ALL SELECT 'distinct', count(*), {_OK}, count(*) >= 4 AND {_OK} FROM u""")  # fmt: skip
def stage_gate(spark, d):
    """The languages as lanes: all documents, and distinct texts only."""
    docs, n = table(spark, d, "documents").select("lang", "text"), F.count(F.lit(1))
    out = None
    for name, rows in (("all", docs), ("distinct", docs.where("length(text) > 0").distinct())):
        lanes = rows.groupBy("lang").agg(n.alias("records"), (n - F.countDistinct("text")).alias("duplicates"), F.avg((F.char_length("text") > 0).cast("int")).alias("verifier_pass_rate"))
        one = B.stage_gate(lanes, 4, 10).select(F.lit(name).alias("input"), "lanes", "all_ok", "skip")
        out = one if out is None else out.unionByName(one)
    return out


@query("preference_scores", "SELECT (count(*) - count(*) FILTER (item_id % 4 = 0))::DOUBLE AS chosen_right, (count(*) FILTER (item_id % 4 = 0))::DOUBLE AS rejected_right, count(*) AS pairs FROM (SELECT row_number() OVER () - 1 AS item_id FROM benchmark)")
def preference_scores(spark, d):
    """As many pairs as there are items, every fourth the wrong way round."""
    p = G.preference_pairs(spark, table(spark, d, "benchmark").count())
    gold, swapped = F.element_at(F.split("chosen", " = "), -1), F.col("idx") % 4 == 0
    score = lambda a, b: V.gsm8k(F.when(swapped, F.col(b)).otherwise(F.col(a)), gold)
    return p.agg(F.sum(score("chosen", "rejected")).alias("chosen_right"), F.sum(score("rejected", "chosen")).alias("rejected_right"), F.count(F.lit(1)).alias("pairs"))


def _stem(item):
    """A question with four choices whose right letter follows the item's number; some break one rule each."""
    k, letter = item % 8, F.substring(F.lit("ABCD"), (item % 4 + 1).cast("int"), F.lit(1))
    question = F.when(k == 1, "short?").otherwise(F.lit("Which of these statements on the motion of a pendulum is right for small swings?"))
    bodies = ("its period grows with the mass", "its period depends on its length", "its speed is the same throughout", "its energy is lost at the turns")
    choices = F.array(*(F.when(k == 2, f"{x}. Option {x}").when(k == 3, f"{x}. no").when(k == 4, f"{x}. not Option A but {b}").otherwise(f"{x}. {b}") for x, b in zip("ABCD", bodies, strict=True)))
    final = F.when(k == 5, "E").when(k == 6, F.substring(F.lit("BCDA"), (item % 4 + 1).cast("int"), F.lit(1))).otherwise(letter)
    said = F.when(k == 7, "Z").otherwise(final)
    return question, F.lit("The period is two pi times the root of length over gravity, so mass plays no part."), choices, final, final, F.concat(F.lit("<think>as derived</think><answer>"), said, F.lit("</answer>"))


@query("stem_rules", """SELECT item_id, CASE item_id % 8 WHEN 1 THEN 'too_shallow_stem_reasoning' WHEN 2 THEN 'placeholder_stem_choices' WHEN 3 THEN 'too_short_stem_choice'
  WHEN 5 THEN 'invalid_stem_choice' WHEN 6 THEN 'stem_answer_distribution_mismatch' WHEN 7 THEN 'verifier_failed_stem' END AS reason FROM benchmark""")  # fmt: skip
def stem_rules(spark, d):
    i = F.col("item_id")
    question, reasoning, choices, final, reference, response = _stem(i)
    return table(spark, d, "benchmark").select("item_id", B.stem_reason(question, reasoning, choices, final, reference, response, i).alias("reason"))


@query("math_rules", """SELECT item_id, CASE WHEN item_id % 10 = 0 THEN 'fallback_zero_answer' WHEN length(trim(text)) < 40 THEN 'too_shallow_math_reasoning' WHEN item_id % 3 = 0 THEN 'verifier_failed_math' END AS reason
  FROM benchmark""")  # fmt: skip
def math_rules(spark, d):
    """Items as questions whose answer is the last digit of their number; every third response is off by one."""
    i = F.col("item_id")
    final = (i % 10).cast("string")
    said = F.concat(F.lit("<think>adding up all that is given</think><answer>"), F.when(i % 3 == 0, i % 10 + 1).otherwise(i % 10), F.lit("</answer>"))
    reasoning = F.lit("We add the numbers that are given one after another and keep the last digit.")
    return table(spark, d, "benchmark").select("item_id", B.math_reason(F.col("text"), reasoning, final, said, final).alias("reason"))


@query("reached_target", """WITH r AS (SELECT event_id, event_type, user_id, coalesce(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
  SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS size FROM r WHERE before < 5000 GROUP BY 1""")  # fmt: skip
def reached_target(spark, d):
    """Events of each type until their sizes have reached a target; the one that crosses it is in."""
    rows = table(spark, d, "events").select("event_id", "event_type", "user_id")
    return B.reached_target(rows, "user_id", ["event_type"], "event_id", 5000).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("size"))


@query("merged_preferences", """WITH p AS (SELECT doc_id, lang, CASE WHEN doc_id % 11 <> 0 THEN left(text, 20) END AS c, CASE WHEN doc_id % 13 = 0 THEN '' ELSE right(text, 20) END AS r FROM documents)
  SELECT lang, count(*) AS n FROM p WHERE c <> '' AND r <> '' GROUP BY lang""")  # fmt: skip
def merged_preferences(spark, d):
    """Pairs of two sets as one; those that lack a text go."""
    from tessera.operators.records import merged_preferences as merged

    i, t = F.col("doc_id"), F.col("text")
    rows = table(spark, d, "documents").select("doc_id", "lang", F.when(i % 11 != 0, F.left(t, F.lit(20))).alias("chosen_text"), F.when(i % 13 == 0, "").otherwise(F.right(t, F.lit(20))).alias("rejected_text"))
    return merged([rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))

"""Queries of lane records: values as text, defaults, supervised and benchmark records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import lanes as L
from tessera.plans.base import query
from tessera.session import table


def _quoted(text: str) -> str:
    """A Python string as an SQL expression."""
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


_ASKED = "'Do it.' || chr(10) || 'Variant: v' || i"
_SIDES = {
    "detection": (
        "CASE WHEN i % 2 = 0 THEN 'body ' || i ELSE 'first line ' || i || ' second' END",
        """'{"domain": "d", "policy_label": "' || CASE WHEN i % 2 = 0 THEN 'block' ELSE 'review' END || '", "rationale": "normalized from teacher output", "risk_tags": [' || CASE WHEN i % 2 = 0 THEN '"a", "b"' ELSE '' END || '], "severity": "medium"}'""",
        None,
    ),
    "code": (
        f"CASE WHEN i % 2 = 0 THEN 'add ' || i ELSE {_ASKED} END",
        f"CASE WHEN i % 2 = 0 THEN '```python' || chr(10) || 'x = ' || i || chr(10) || '```' ELSE '```python' || chr(10) || {_quoted(L.NO_CODE)} || chr(10) || '```' END",
        f"CASE WHEN i % 2 = 0 THEN 'assert x == ' || i ELSE {_quoted(L.NO_VERIFIER)} END",
    ),
    "math": (
        f"CASE WHEN i % 2 = 0 THEN 'How many are ' || i || '?' ELSE {_ASKED} END",
        f"'<think>' || CASE WHEN i % 2 = 0 THEN 'count' ELSE {_quoted(L.NO_REASONING['math'])} END || '</think><answer>' || i || '</answer>'",
        "i::VARCHAR",
    ),
    "stem_reasoning": (
        f"CASE WHEN i % 2 = 0 THEN 'Which is ' || i || '?' || chr(10) || chr(10) || 'Choices:' || chr(10) || 'A. one' || chr(10) || 'B. two' ELSE {_ASKED} || chr(10) || chr(10) || 'Choices:' || chr(10) || {_quoted(chr(10).join(L.NO_CHOICES))} END",
        f"'<think>{L.NO_REASONING['stem_reasoning']}</think><answer>' || CASE WHEN i % 2 = 0 THEN 'B' ELSE 'C' END || '</answer>'",
        "CASE WHEN i % 2 = 0 THEN 'B' ELSE 'C' END",
    ),
    "tool_use": (
        f"CASE WHEN i % 2 = 0 THEN 'read p' || i ELSE {_ASKED} END",
        """CASE WHEN i % 2 = 0 THEN '{"arguments": {"path": "p' || i || '"}, "tool_name": "mcp.read"}' ELSE '{"arguments": {}, "tool_name": "tool.call"}' END""",
        """CASE WHEN i % 2 = 0 THEN '{"arguments": {"path": "p' || i || '"}, "tool_name": "mcp.read"}' ELSE '{"arguments": {}, "tool_name": "tool.call"}' END""",
    ),
}
_SQL = "WITH b AS (SELECT item_id AS i FROM benchmark) " + " UNION ALL ".join(
    f"SELECT i AS item_id, '{lane}' AS lane, '{L.BUCKET.format(lane=lane)}' AS bucket, '{L.TASKS[lane]}' AS task, sha1({_quoted(L.PROMPTS[lane])} || {asked}) AS prompt_sha1, {said} AS response, {gold or said} AS reference FROM b"
    for lane, (asked, said, gold) in _SIDES.items()
)


@query("lane_records", _SQL)
def lane_records(spark, d):
    """A record of each lane for each item: every second answer is JSON or key: value lines, the others give little, so that defaults stand in."""
    i = F.col("item_id").cast("string")
    even, none = F.col("item_id") % 2 == 0, F.lit(None).cast("string")
    some = lambda *parts: F.when(even, F.concat(*parts))
    answers = {
        "detection": (F.when(even, F.concat(F.lit("- input_text: body "), i, F.lit("\npolicy_label: block\nrisk_tags: [a, b]"))).otherwise(F.concat(F.lit("first line "), i, F.lit("\n\nsecond"))), none),
        "code": (F.lit(""), some(F.lit('{"user_request": "add '), i, F.lit('", "assistant_code": "x = '), i, F.lit('", "verifier_snippet": "assert x == '), i, F.lit('"}'))),
        "math": (F.concat(F.lit("so it is 1,2 and then "), i), some(F.lit('{"question": "How many are '), i, F.lit('?", "reasoning": "count", "reference": "'), i, F.lit('"}'))),
        "stem_reasoning": (F.lit("it may be A but it is c."), some(F.lit('{"question": "Which is '), i, F.lit('?", "choices": ["A. one", " ", "B. two"], "final_choice": "b"}'))),
        "tool_use": (F.lit(""), some(F.lit('{"user_request": "read p'), i, F.lit('", "tool_name": "mcp.read", "arguments": {"path": "p'), i, F.lit('"}}'))),
    }
    out = []
    for lane, (text, parsed) in answers.items():
        rows = table(spark, d, "benchmark").select("item_id", text.alias("answer"), parsed.alias("parsed"))
        task = {"description": F.lit("Do it."), "variant": F.concat(F.lit("v"), i), "domain": F.lit("d"), "target_label": F.lit("review"), "mode": F.lit("positive"), "tags": F.array(F.lit("t"))}
        fields = L.completed(lane, L.answered(lane, F.col("answer"), F.col("parsed")), F.col("answer"), task)
        made = L.record(rows, lane, fields, task, F.lit("teacher"), F.lit("train"))
        out.append(made.select("item_id", F.lit(lane).alias("lane"), "bucket", "task", F.sha1("prompt").alias("prompt_sha1"), "response", "reference"))
    return reduce(DataFrame.unionByName, out)


@query("value_texts", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN event_id || chr(10) || 'x' || chr(10) WHEN 2 THEN 'user: c' || event_id || chr(10) || chr(10) || 'gpt: v' WHEN 3 THEN event_type ELSE '' END AS text,
  CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN event_id || chr(10) || 'x' || chr(10) WHEN 2 THEN '{"content": "c' || event_id || '", "role": "user"}' || chr(10) || '{"from": "gpt", "value": "v"}' WHEN 3 THEN event_type ELSE '' END AS plain FROM events""")  # fmt: skip
def value_texts(spark, d):
    """Objects, lists, turns, strings and nulls as text, with turns as paragraphs and without."""
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 5
    turns = F.concat(F.lit('[{"role": "user", "content": "c'), i, F.lit('"}, {"from": "gpt", "value": "v"}]'))
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), i, F.lit(', "x", null]'))).when(k == 2, turns).when(k == 3, F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    return table(spark, d, "events").select("event_id", L.stringified(raw).alias("text"), L.stringified(raw, turns=False).alias("plain"))


@query("choice_lists", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'one|two' WHEN 1 THEN 'A. first|C. ' || event_type WHEN 2 THEN 'x|' || event_id ELSE 'A. Option A|B. Option B|C. Option C|D. Option D' END AS choices FROM events""")
def choice_lists(spark, d):
    k, i = F.col("event_id") % 4, F.col("event_id").cast("string")
    raw = F.when(k == 0, '["one", " ", "two "]').when(k == 1, F.concat(F.lit('{"C": "'), F.col("event_type"), F.lit('", "A": "first", "B": " "}'))).when(k == 2, F.concat(F.lit("x\n\n "), i))
    return table(spark, d, "events").select("event_id", F.array_join(L.choice_list(raw), "|").alias("choices"))


@query("benchmark_rows", """SELECT 'p' || item_id AS prompt, CASE WHEN item_id % 3 = 0 THEN 'r' || item_id ELSE 'g' || item_id END AS reference, CASE WHEN item_id % 2 = 0 THEN 'exact_match' ELSE 'gsm8k' END AS task FROM benchmark WHERE item_id % 5 <> 0""")
def benchmark_rows(spark, d):
    """Records without a response are left out; a missing reference is the response, a blank task the lane's."""
    i = F.col("item_id")
    name = lambda x: F.concat(F.lit(x), i)
    rows = table(spark, d, "benchmark").select(
        F.concat(F.lit(" p"), i).alias("prompt"), F.when(i % 5 != 0, name("r")).otherwise(" ").alias("response"), F.when(i % 3 != 0, name("g")).alias("reference"),
        F.when(i % 2 == 0, "exact_match").otherwise(" ").alias("task"), F.lit("b").alias("bucket"), F.lit("s").alias("source"), F.struct(i.alias("id")).alias("metadata"),
    )
    return L.benchmark_rows(rows, "gsm8k").select("prompt", "reference", "task")


@query("lane_details", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'stem_reasoning' ELSE 'detection' END AS lane, array_to_string(list_sort(list_distinct([event_type, 'b', 'a', event_type])), ',') AS tags,
  ['h0', 'h1', 'h2'][((event_id + 5) % 3 + 1)::INT] AS hint, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE '0' END AS number, 'Q: one' || chr(10) || 'A: 1' || chr(10) || chr(10) || 'Q: ' || event_type || chr(10) || 'A:' AS prompt FROM events""")  # fmt: skip
def lane_details(spark, d):
    i = F.col("event_id")
    text = F.when(i % 2 == 0, F.concat(F.lit("from 3 to "), i)).otherwise("none")
    return table(spark, d, "events").select(
        "event_id", L.lane_name(F.when(i % 2 == 0, " STEM-reasoning ")).alias("lane"), F.array_join(L.tag_union(F.array("event_type", F.lit("b")), F.array(F.lit("a"), F.col("event_type"))), ",").alias("tags"),
        L.diversity_hint(i, 5, ("h0", "h1", "h2")).alias("hint"), L.last_number_or_zero(text).alias("number"), L.few_shot((("one", "1"),), F.col("event_type"), "Q: ", "A:").alias("prompt"),
    )

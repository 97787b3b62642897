"""Shaping of corpus, supervised, preference and benchmark records."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import text as T

#: Speaker names of roles; others are capitalised, the empty one is a user.
TAGS = {"human": "User", "user": "User", "prompter": "User", "gpt": "Assistant", "assistant": "Assistant", "system": "System"}


def speaker(role: Column) -> Column:
    low = F.lower(F.coalesce(role, F.lit("")))
    out = F
    for name, tag in TAGS.items():
        out = out.when(low == name, tag)
    return out.when(low == "", "User").otherwise(T.capitalize(low))


def render_turns(turns: Column, marked: bool = False, tools: Column | None = None) -> Column:
    """An array of (role, content) as paragraphs `Tag: text`, or marked as `<|role|>` lines; blank turns are left out, null without any."""
    if marked:
        kept = F.filter(turns, lambda t: F.coalesce(t["content"], F.lit("")) != "")
        parts = F.transform(kept, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), t["content"]))
        if tools is not None:
            parts = F.concat(F.filter(F.array(F.concat(F.lit("<|tools|>\n"), T.truthy(tools))), lambda x: x.isNotNull()), parts)
    else:
        kept = F.filter(turns, lambda t: T.strip_u(F.coalesce(t["content"], F.lit(""))) != "")
        parts = F.transform(kept, lambda t: F.concat(speaker(t["role"]), F.lit(": "), T.strip_u(t["content"])))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n"))


def gathered(conversations: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row a conversation with its turns (role, content) in order."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("role").alias("role"), F.col("text").alias("content"))))
    return conversations.groupBy(key).agg(turns.alias("turns"))


# Text projections of corpus records.


def plain(*fields: str) -> Column:
    return F.coalesce(*(T.truthy(F.col(f)) for f in fields))


def instruction_output(instruction: Column, output: Column) -> Column:
    i, o = T.truthy(instruction), T.truthy(output)
    return F.coalesce(F.concat(F.lit("Q: "), i, F.lit("\n\nA: "), o), i, o)


def message(role: Column, text: Column) -> Column:
    name = F.coalesce(role, F.lit("user"))
    tag = F.when(name == "prompter", "User").when(name == "assistant", "Assistant").otherwise(T.capitalize(name))
    return F.concat(tag, F.lit(": "), T.truthy(text))


def chosen_only(prompt: Column, chosen: Column) -> Column:
    p, c = T.truthy(prompt), T.truthy(chosen)
    return F.coalesce(F.concat(F.lit("User: "), p, F.lit("\n\nAssistant: "), c), c)


def pair(first: Column, second: Column, labels: tuple[str, str] | None = None) -> Column:
    """Two non-empty sides as paragraphs, with labels or bare."""
    a, b = T.truthy(first), T.truthy(second)
    if labels:
        a, b = F.concat(F.lit(f"{labels[0]}: "), a), F.concat(F.lit(f"{labels[1]}: "), b)
    return F.concat(a, F.lit("\n\n"), b)


def blocks(parts: list[tuple[str, Column]]) -> Column:
    """Labelled blocks; empty ones are left out."""
    return T.truthy(F.concat_ws("\n\n", *(F.concat(F.lit(f"{label}\n" if label else ""), T.truthy(c)) for label, c in parts)))


def code(language: Column, body: Column, least: int = 64) -> Column:
    return F.when(F.char_length(body) >= least, F.concat(F.lit("# language: "), F.coalesce(T.truthy(language), F.lit("unknown")), F.lit("\n"), body))


def teacher_prompt(text: Column, least: int = 32, most: int = 1024) -> Column:
    """The first paragraph of a text of least or more characters, cut to most."""
    return F.when(F.char_length(text) >= least, F.substring(F.get(F.split(T.strip_u(text), "\n\n", 2), F.lit(0)), 1, most))


def answer_split(text: Column) -> tuple[Column, Column]:
    """Question and `#### gold` of a worked example; null unless both are there."""
    parts = F.split(text, r"####\s*", 2)
    question, gold = T.strip_u(F.get(parts, F.lit(0))), T.strip_u(F.get(F.split(T.strip_u(F.get(parts, F.lit(1))), "\n"), F.lit(0)))
    whole = (question != "") & (gold != "")
    return F.when(whole, question), F.when(whole, F.concat(F.lit("#### "), gold))


def labelled(text: Column, **labels: Column) -> Column:
    return F.struct(text.alias("text"), *(c.alias(k) for k, c in labels.items()))


def _literal_chat(raw: str | None) -> str | None:
    try:
        value = ast.literal_eval(raw or "")
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    turns = value.get("messages")
    if isinstance(turns, list) and turns:
        spoken = [(t.get("role", ""), t.get("content", "")) for t in turns if isinstance(t, dict)]
        return "\n".join(f"<|{role}|>\n{content}" for role, content in spoken if content) or None
    sides = [value.get("problem") or value.get("question"), value.get("solution") or value.get("answer")]
    return "\n\n".join(map(str, sides)) if all(sides) else None


@F.pandas_udf(StringType())
def literal_chat(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A Python-literal record as chat text, or as problem and solution; null for others."""
    for s in batches:
        yield s.map(_literal_chat)


def _canonical(raw: str | None) -> str | None:
    try:
        return json.dumps(json.loads(raw or ""), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON with sorted keys, null if it doesn't parse."""
    for s in batches:
        yield s.map(_canonical)


def json_object(text: Column) -> Column:
    """The JSON object in a model's text: in a fence, the whole, or from the first { to the last }; null without one."""
    clean = T.strip_u(text)
    fenced = T.truthy(T.strip_u(F.regexp_extract(clean, r"(?s)```(?:json)?(.*?)```", 1)))
    body = F.coalesce(fenced, clean)
    inner = T.truthy(F.regexp_extract(body, r"(?s)\{.*\}", 0))
    whole = lambda c: F.when(c.rlike(r"(?s)^\s*\{") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(whole(body), whole(inner))


def key_values(text: Column, keys: tuple[str, ...], lists: tuple[str, ...] = ()) -> Column:
    """`key: value` lines as a map of the allowed keys, the last of a key winning; lists are comma separated."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: T.strip_u(F.regexp_replace(T.strip_u(x), r"^[-*]+", "")))
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.lower(T.strip_u(F.get(F.split(x, ":", 2), F.lit(0)))).alias("key"), T.strip_u(F.get(F.split(x, ":", 2), F.lit(1))).alias("value")))
    found = F.filter(pairs, lambda p: p["key"].isin(*keys))
    latest = lambda k: F.try_element_at(F.transform(F.filter(found, lambda p: p["key"] == k), lambda p: p["value"]), F.lit(-1))
    clean = lambda k: F.array_join(F.filter(F.transform(F.split(F.regexp_replace(latest(k), r"^\[|\]$", ""), ","), T.strip_u), lambda x: x != ""), ",") if k in lists else latest(k)
    return F.map_filter(F.create_map(*(c for k in keys for c in (F.lit(k), clean(k)))), lambda _, v: v.isNotNull())


# Records.


def sft(rows: DataFrame, bucket: str, source: str, prompt: Column, response: Column, system: Column | None = None) -> DataFrame:
    """Supervised records; rows without prompt or response are dropped."""
    system = F.lit("") if system is None else F.coalesce(T.strip_u(system), F.lit(""))
    p, r = T.truthy(T.strip_u(prompt)), T.truthy(T.strip_u(response))
    return rows.select("*", p.alias("prompt"), r.alias("response"), system.alias("system")).where("prompt IS NOT NULL AND response IS NOT NULL").withColumns(
        {"bucket": F.lit(bucket), "mode": F.lit("sft"), "source": F.lit(source), "text": T.chat_text(F.col("prompt"), F.col("response"), F.col("system"))}
    )


def preference(rows: DataFrame, bucket: str, source: str, prompt: Column, chosen: Column, rejected: Column) -> DataFrame:
    p, c, r = (T.truthy(T.strip_u(x)) for x in (prompt, chosen, rejected))
    return rows.select("*", p.alias("prompt"), c.alias("chosen"), r.alias("rejected")).where("prompt IS NOT NULL AND chosen IS NOT NULL AND rejected IS NOT NULL").withColumns(
        {"bucket": F.lit(bucket), "mode": F.lit("preference"), "source": F.lit(source), "chosen_text": T.chat_text(F.col("prompt"), F.col("chosen")), "rejected_text": T.chat_text(F.col("prompt"), F.col("rejected"))}
    )


def benchmark_cases(rows: DataFrame, name: str, task: str, known: tuple[str, ...], prompt: Column, reference: Column) -> DataFrame:
    """Cases with prompt and reference; a row's own known task wins over the benchmark's."""
    own = F.when(F.col("task").isin(*known), F.col("task")).otherwise(task) if "task" in rows.columns else F.lit(task)
    return rows.select(F.lit(name).alias("benchmark"), own.alias("task"), T.truthy(T.strip_u(prompt)).alias("prompt"), T.truthy(T.strip_u(reference)).alias("reference")).where("prompt IS NOT NULL AND reference IS NOT NULL")


#: A contract line of tool prompts and what takes its place.
TOOL_MARKER = "Return strict JSON with keys: tool_name, arguments.\nDo not add prose or markdown fences."
TOOL_CONTRACT = (
    "Return your result using <think>...</think><answer>...</answer>.\n"
    "Inside <answer>, put strict JSON with exactly the keys: tool_name, arguments.\n"
    "Preserve safety-critical arguments such as read_only, dry_run, request_id, and limits."
)
TOOL_THOUGHT = "<think>Select the safest matching tool and preserve required arguments.</think>"


def repaired_tool(rows: DataFrame) -> DataFrame:
    """prompt with the tagged contract, response with the canonical reference."""
    return rows.withColumn("prompt", F.replace("prompt", F.lit(TOOL_MARKER), F.lit(TOOL_CONTRACT))).withColumn("response", F.concat(F.lit(f"{TOOL_THOUGHT}<answer>"), canonical_json(F.col("reference")), F.lit("</answer>")))


def merged_preferences(parts: list[DataFrame]) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, parts).where("chosen_text IS NOT NULL AND rejected_text IS NOT NULL AND chosen_text <> '' AND rejected_text <> ''")

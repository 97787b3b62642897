"""Deterministic record sources: an index gives a record, by templates and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Templates of each lane: task name, prompt and answer, with {a} and {b} drawn from the index.
TEMPLATES = {
    "math": [
        ("sum", "A shop sells {a} pens on Monday and {b} pens on Tuesday. How many pens does it sell on both days together?", lambda a, b: a + b),
        ("product", "A hall has {a} rows with {b} seats in each row. How many seats does the hall have in total?", lambda a, b: a * b),
        ("difference", "A tank holds {a} litres more than a barrel of {b} litres. How many litres does the tank hold?", lambda a, b: a + b),
    ],
    "tool_use": [
        ("read", "Read file {a} of workspace {b} without changing it.", lambda a, b: a),
        ("search", "Search workspace {b} for ticket {a}.", lambda a, b: a),
    ],
}


def drawn(index: Column, salt: str, low: int, high: int) -> Column:
    """A number from low to high that only depends on index and salt."""
    return low + F.pmod(F.xxhash64(index, F.lit(salt)), F.lit(high - low + 1))


def generate(spark: SparkSession, lane: str, count: int, seed: str = "seed") -> DataFrame:
    """idx, lane, task_name, prompt, answer, reference for indexes from 0."""
    templates = TEMPLATES[lane]
    rows = spark.range(count).select(F.col("id").alias("idx"), drawn(F.col("id"), f"{seed}a", 2, 97).alias("a"), drawn(F.col("id"), f"{seed}b", 2, 97).alias("b"))
    kind = F.col("idx") % len(templates)
    pick = lambda options: F.element_at(F.array(*options), (kind + 1).cast("int"))
    fields = {"a": F.col("a"), "b": F.col("b")}
    answer = pick([f(F.col("a"), F.col("b")) for _, _, f in templates]).cast("string")
    reference = answer
    if lane == "tool_use":
        name = pick([F.lit(f"mcp.{t}") for t, _, _ in templates])
        reference = F.concat(F.lit('{"arguments": {"id": '), F.col("a"), F.lit(', "read_only": true}, "tool_name": "'), name, F.lit('"}'))
    return rows.select("idx", F.lit(lane).alias("lane"), pick([F.lit(t) for t, _, _ in templates]).alias("task_name"), pick([T.fill(p, fields) for _, p, _ in templates]).alias("prompt"), answer.alias("answer"), reference.alias("reference"))


def as_records(examples: DataFrame) -> DataFrame:
    """Examples as supervised records of their lane."""
    thought = F.concat(F.lit("<think>Read the numbers, choose the operation and compute it step by step.</think><answer>"), F.col("reference"), F.lit("</answer>"))
    response = F.when(F.col("lane") == "tool_use", F.col("reference")).otherwise(thought)
    task = F.when(F.col("lane") == "tool_use", "json_match").otherwise("exact_math")
    return examples.select("idx", "lane", "task_name", task.alias("task"), "prompt", response.alias("response"), "reference", T.chat_text(F.col("prompt"), response).alias("text"))


def preference_pairs(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """Pairs whose choices are drawn by CPython's generator, in index order; count is a parameter of the job."""
    shape = "idx long, prompt string, chosen string, rejected string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import random

        for f in frames:
            drawn_rows = []
            for i in f.id:
                own = random.Random(seed * 1_000_003 + int(i))
                a, b = own.randrange(2, 50), own.randrange(2, 50)
                drawn_rows.append((i, f"What is {a} + {b}?", f"{a} + {b} = {a + b}", f"{a} + {b} = {a + b + own.choice((-2, -1, 1, 2))}"))
            yield pd.DataFrame(drawn_rows, columns=["idx", "prompt", "chosen", "rejected"])

    return spark.range(count).mapInPandas(run, shape)

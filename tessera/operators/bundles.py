"""Validation, summaries and gates of generated record bundles."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import json_values as J
from tessera.functions import text as T
from tessera.functions import verifiers as V
from tessera.operators.order import with_running
from tessera.session import checkpoint

# Fixed values of the record rules.
LANES = ("detection", "code", "math", "stem_reasoning", "tool_use")
MIN_RESPONSE = {"code": 48, "math": 32, "stem_reasoning": 40, "tool_use": 16}
MIN_REFERENCE = {"code": 12, "math": 1, "stem_reasoning": 1, "tool_use": 16}
SCHEMA_RATE, VERIFIER_RATE, MOST_ONE_ANSWER = 0.98, 0.85, 0.60
DESTRUCTIVE = r"(?i)(remove-item|rm -rf|del /|format |drop table|delete from|git reset --hard)"
PLACEHOLDER = r"(?i)^[A-E]\.\s*Option\s+[A-E]\s*$"


def least_length(lane: Column, table: dict[str, int]) -> Column:
    out = F
    for name, n in table.items():
        out = out.when(lane == name, n)
    return out.otherwise(1)


def zero_answer(answer: Column) -> Column:
    return F.coalesce(F.abs(F.regexp_replace(F.replace(T.strip_u(answer), F.lit(","), F.lit("")), r"\.+$", "").try_cast("double")) < 1e-12, F.lit(False))


def concrete(json_text: Column) -> Column:
    """Some value inside, at any depth, is a non-blank string, a number or a boolean."""
    return J.concrete(json_text)


def destructive(arguments: Column) -> Column:
    exempt = F.coalesce((F.get_json_object(arguments, "$.dry_run") == "true") | (F.get_json_object(arguments, "$.read_only") == "true"), F.lit(False))
    return arguments.rlike(DESTRUCTIVE) & ~exempt


def common_reason(lane: Column, response: Column, reference: Column, rationale: Column) -> Column:
    r, g = T.strip_u(F.coalesce(response, F.lit(""))), T.strip_u(F.coalesce(reference, F.lit("")))
    return (
        F.when(F.char_length(r) < least_length(lane, MIN_RESPONSE), "too_short_response")
        .when(F.char_length(g) < least_length(lane, MIN_REFERENCE), "too_short_reference")
        .when(r.rlike(T.FALLBACK) | F.coalesce(rationale, F.lit("")).rlike(T.FALLBACK), "fallback_or_refusal_output")
    )


def math_reason(question: Column, reasoning: Column, final: Column, response: Column, reference: Column) -> Column:
    return (
        F.when(zero_answer(final), "fallback_zero_answer")
        .when((F.char_length(T.strip_u(question)) < 40) | (F.char_length(T.strip_u(reasoning)) < 48), "too_shallow_math_reasoning")
        .when(V.exact_math(response, reference) < 1, "verifier_failed_math")
    )


def stem_reason(question: Column, reasoning: Column, choices: Column, final: Column, reference: Column, response: Column, place: Column) -> Column:
    wanted = F.substring(F.lit("ABCD"), (place % 4 + 1).cast("int"), F.lit(1))
    body = lambda c: T.strip_u(F.element_at(F.split(c, r"\.", 2), -1))
    f, g = F.upper(T.strip_u(final)), F.upper(T.strip_u(reference))
    return (
        F.when((F.size(choices) < 4) | F.exists(choices, lambda c: c.rlike(PLACEHOLDER)), "placeholder_stem_choices")
        .when((F.char_length(T.strip_u(question)) < 60) | (F.char_length(T.strip_u(reasoning)) < 48), "too_shallow_stem_reasoning")
        .when(F.exists(F.slice(choices, 1, 4), lambda c: F.char_length(body(c)) < 12), "too_short_stem_choice")
        .when(~(f.isin(*"ABCD") & g.isin(*"ABCD")), "invalid_stem_choice")
        .when((f != wanted) | (g != wanted), "stem_answer_distribution_mismatch")
        .when(V.mcq(response, reference) < 1, "verifier_failed_stem")
    )


def tool_reason(name: Column, arguments: Column, response: Column, reference: Column) -> Column:
    """arguments is JSON text; parsed equality of response and reference is left to json_match()."""
    n = T.strip_u(F.coalesce(name, F.lit("")))
    return (
        F.when(F.coalesce(~arguments.rlike(r'^\s*\{\s*"'), F.lit(True)), "empty_tool_arguments")
        .when((n == "") | (n == "tool.call"), "generic_tool_name")
        .when(~F.lower(n).rlike(r"^(mcp|agent)\."), "non_mcp_agent_tool_name")
        .when(~concrete(arguments), "non_concrete_tool_arguments")
        .when(destructive(arguments), "destructive_tool_arguments")
        .when(V.json_match(response, reference) < 1, "verifier_failed_tool_json")
    )


def code_reason(code: Column, verifier: Column, language: Column, task: Column, response: Column, reference: Column) -> Column:
    """Static rules of the code lane; running the candidate isn't done here."""
    asserts = F.regexp_count(verifier, F.lit(r"\bassert\b"))
    foreign = F.lower(F.coalesce(T.truthy(T.strip_u(language)), F.lit("python"))) != "python"
    names = F.array_intersect(V.top_level_names(code), F.filter(V.top_level_names(verifier), lambda n: ~n.startswith("test_")))
    return (
        F.when(F.lower(F.regexp_replace(code, r"\s+", "")).contains("returnnone") | code.rlike(r"(?i)\bpass\b|todo"), "fallback_code_stub")
        .when(foreign & (task != "code_static_spec"), "non_python_code_must_use_static_spec")
        .when(foreign & ~verifier.rlike(V.EXPECTATION), "missing_static_code_harness")
        .when(foreign & (V.code_static_spec(response, reference) < 1), "verifier_failed_code_static_spec")
        .when(foreign, F.lit(None).cast("string"))
        .when(~V.typed_callable(code), "missing_typed_public_callable")
        .when(asserts == 0, "missing_assert_verifier")
        .when(~V.executing_assert(verifier), "non_executing_assert_verifier")
        .when(F.size(names) > 0, "verifier_redefines_candidate_api")
        .when(F.lower(verifier).contains("assert callable") & (asserts <= 1), "callable_only_verifier")
    )


def accept_in_order(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """order, keys, round of the rows that a walk in order accepts: those that share no key with a row accepted before.

    The walk is done in rounds over what is undecided: a row that comes first under each of its keys is
    accepted, and what shares a key with it goes. Rows in random order are decided in a few rounds; a
    round is needed for each link of the longest chain of rows that each wait for the one before.
    order tells rows apart; keys are not null.
    """
    left, accepted, number = rows.select(order, *keys), [], 0
    while True:
        number += 1
        marked = left
        for i, key in enumerate(keys):
            marked = marked.join(left.groupBy(key).agg(F.min(order).alias(f"__first{i}")), key)
        ahead = F.lit(True)
        for i in range(len(keys)):
            ahead = ahead & (F.col(order) == F.col(f"__first{i}"))
        marked = checkpoint(marked.select(order, *keys, ahead.alias("__ahead")), "round")
        taken, rest = marked.where("__ahead"), marked.where("NOT __ahead")
        accepted.append(taken.select(order, *keys, F.lit(number).alias("round")))
        for key in keys:
            rest = rest.join(taken.select(key), key, "left_anti")
        left = checkpoint(rest.select(order, *keys), "undecided")
        if left.isEmpty():
            return functools.reduce(DataFrame.unionByName, accepted)


def reject_duplicates(rows: DataFrame, order: str, text: str = "text", prompt: str = "prompt", reason: str = "reason") -> DataFrame:
    """order, reason, round: a row without a reason is refused as duplicate_text, else duplicate_prompt, where a row that was accepted before it has its text or prompt.

    Refused rows block nothing. round is the round in which a row was accepted, null for others.
    Texts are read once, for their digests; what is joined afterwards is small rows. Null texts and
    prompts count as empty.
    """
    digest = lambda c: F.sha1(T.fingerprint(F.coalesce(F.col(c), F.lit(""))))
    marked = checkpoint(rows.select(order, reason, digest(text).alias("__t"), digest(prompt).alias("__p")), "digests")
    accepted = accept_in_order(marked.where(F.col(reason).isNull()), order, ["__t", "__p"])
    by = lambda key: accepted.select(key, F.col(order).alias(f"{key}_by"), *([F.col("round")] if key == "__t" else []))
    known = marked.join(by("__t"), "__t", "left").join(by("__p"), "__p", "left")
    before = lambda key: F.col(f"{key}_by") < F.col(order)
    told = F.coalesce(F.col(reason), F.when(before("__t"), "duplicate_text").when(before("__p"), "duplicate_prompt"))
    return known.select(order, told.alias(reason), F.when(told.isNull(), F.col("round")).alias("round"))


def bundle_summary(records: DataFrame) -> DataFrame:
    """One row of totals, rates and duplicate counts; prompt, text, valid and score are columns of records."""
    n = F.count(F.lit(1))
    out = records.agg(
        n.alias("total_records"),
        F.count_if("valid").alias("valid_json_records"),
        (n - F.countDistinct("text")).alias("exact_duplicate_count"),
        (n - F.countDistinct("prompt")).alias("duplicate_prompt_count"),
        F.countDistinct(F.sha1(T.fingerprint(F.col("text")))).alias("unique_texts"),
        F.count("score").alias("verifier_total"),
        F.count_if(F.col("score") >= 1).alias("verifier_pass_count"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumns(
        {
            "schema_valid_rate": rate("valid_json_records", "total_records"),
            "unique_text_ratio": rate("unique_texts", "total_records"),
            "exact_duplicate_ratio": rate("exact_duplicate_count", "total_records"),
            "verifier_pass_rate": rate("verifier_pass_count", "verifier_total"),
        }
    ).drop("unique_texts")


def histograms(records: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts of each value of each dimension, by grouping sets of one dimension each."""
    sides = F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dimensions))
    return records.select(F.explode(sides).alias("s")).groupBy(F.col("s.dimension").alias("dimension"), F.col("s.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def gate_failures(summary: DataFrame, least_unique: float = 0.95, most_duplicates: float = 0.0, lane: str = "", top_answer: str | None = None) -> DataFrame:
    """Which of the gate's rules a summary fails."""
    stem = F.col("total_records") >= 4 if lane == "stem_reasoning" and top_answer else F.lit(False)
    rules = [
        F.when(F.col("schema_valid_rate") < SCHEMA_RATE, "schema_valid_rate"),
        F.when(F.col("unique_text_ratio") < least_unique, "unique_text_ratio"),
        F.when(F.col("exact_duplicate_ratio") > most_duplicates, "exact_duplicate_ratio"),
        F.when(F.col("verifier_pass_rate") < VERIFIER_RATE, "verifier_pass_rate"),
        F.when(F.col("total_records") < F.col("attempted_tasks"), "accepted_records") if "attempted_tasks" in summary.columns else F.lit(None).cast("string"),
        F.when(stem & (F.col(top_answer) / F.col("total_records") > MOST_ONE_ANSWER), "answer_bias") if top_answer else F.lit(None).cast("string"),
    ]
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return summary.withColumn("failures", F.when(F.col("total_records") <= 0, F.array(F.lit("no accepted records"))).otherwise(found))


def failure_contrast(rows: DataFrame, failures: Column, score: Column) -> DataFrame:
    """One row for each bad response of a record, with the score that a verifier gives it (0 is expected)."""
    each = rows.withColumn("failure", F.explode(failures))
    return each.withColumn("bad_response", F.col("failure.bad_response")).withColumn("failure_label", F.col("failure.label")).withColumn("expected_score", F.lit(0.0)).withColumn("observed_score", score).drop("failure")


def reached_target(sizes: DataFrame, size: str, group: list[str], order: str, target: int) -> DataFrame:
    """Rows until the group's running size reaches the target."""
    return with_running(sizes, size, group, [order], "__b").where(F.col("__b") < target).drop("__b")


def stage_gate(lanes: DataFrame, required: int, least_records: int) -> DataFrame:
    """Whether all required lanes are there with enough records, no duplicates and full pass rates."""
    ok = (F.col("records") >= least_records) & (F.col("verifier_pass_rate") >= 1.0) & (F.col("duplicates") == 0)
    return lanes.agg(F.count(F.lit(1)).alias("lanes"), F.coalesce(F.bool_and(ok), F.lit(False)).alias("all_ok")).withColumn("skip", (F.col("lanes") >= required) & F.col("all_ok"))

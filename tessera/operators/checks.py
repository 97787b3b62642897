"""Checks around bundles and runs: older bundles' heuristics and gates, fetch and reset guards, choice of stages and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Fixed values of the older bundles' rules.
PLACEHOLDERS = tuple(f"{x}. Option {x}" for x in "ABCD")
EMPTY_ARGUMENTS = ('"arguments": {}', '"arguments":{}', "'arguments': {}")
SKEWED_LANES = ("math", "stem_reasoning", "tool_use")
MOST_DUPLICATES, MOST_ONE_REFERENCE = 0.50, 0.75
#: The heuristic that each lane must be free of, and what is said of it.
LANE_REASONS = {
    "code": ("fallback_return_none", "code fallback `def solve(): return None` records detected"),
    "math": ("answer_zero_count", "math fallback `<answer>0</answer>` records detected"),
    "stem_reasoning": ("placeholder_choice_count", "stem placeholder `Option A/B/C/D` choices detected"),
    "tool_use": ("empty_arguments_count", "tool-use empty `arguments: {}` records detected"),
}


def _any(c: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def bundle_heuristics(rows: DataFrame) -> DataFrame:
    """One row of counts over prompt, text, response and reference; null fields are empty.

    Distinct prompts and texts are counted by digest. The most common reference comes from
    pre-aggregated counts.
    """
    p, t, r, g = (F.coalesce(c, F.lit("")) for c in ("prompt", "text", "response", "reference"))
    held = rows.select(p.alias("p"), t.alias("t"), r.alias("r"), g.alias("g"))
    in_each = lambda needles: sum((_any(F.col(c), needles).cast("int") for c in "rgt"), F.lit(0))
    placeholder = F.lit(True)
    for x in PLACEHOLDERS:
        placeholder = placeholder & F.col("p").contains(x)
    counts = held.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct(F.sha1("p")).alias("unique_prompts"),
        F.countDistinct(F.sha1("t")).alias("unique_texts"),
        F.coalesce(F.sum(in_each(("return None",))), F.lit(0)).alias("fallback_return_none"),
        F.count_if((T.strip_u(F.col("g")) == "0") | F.col("r").contains("<answer>0</answer>")).alias("answer_zero_count"),
        F.count_if(placeholder).alias("placeholder_choice_count"),
        F.coalesce(F.sum(in_each(EMPTY_ARGUMENTS)), F.lit(0)).alias("empty_arguments_count"),
    )
    most = held.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]  # one number
    return counts.withColumn("most_one_reference", F.lit(most or 0).cast("long"))


def heuristic_gate(counts: DataFrame, lane: str, allowed: bool = False) -> DataFrame:
    """The counts with ratios, the lane's reasons to fail, and whether it does; `allowed` lets it pass all the same."""
    total = F.greatest(F.lit(1), F.col("total_records"))
    rated = counts.withColumns(
        {
            "duplicate_prompt_ratio": (F.col("total_records") - F.col("unique_prompts")) / total,
            "duplicate_text_ratio": (F.col("total_records") - F.col("unique_texts")) / total,
            "max_reference_ratio": F.col("most_one_reference") / total,
        }
    )
    rules = [
        F.when(F.col("duplicate_prompt_ratio") > MOST_DUPLICATES, "duplicate prompt ratio exceeds 50%"),
        F.when(F.col("duplicate_text_ratio") > MOST_DUPLICATES, "duplicate text ratio exceeds 50%"),
        F.when((F.col("max_reference_ratio") > MOST_ONE_REFERENCE) & F.lit(lane in SKEWED_LANES), "reference label/value skew exceeds 75%"),
    ]
    if lane in LANE_REASONS:
        column, said = LANE_REASONS[lane]
        rules.insert(0, F.when(F.col(column) > 0, said))
    reasons = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return rated.withColumn("reasons", reasons).withColumn("quality_failed", (F.size("reasons") > 0) & F.lit(not allowed))


def case_gate(rows: DataFrame) -> DataFrame:
    """One row on multiple-choice cases: placeholders, duplicate prompts above a quarter and one reference above three quarters fail."""
    total = F.greatest(F.lit(1), F.col("total_records"))
    duplicates = F.col("total_records") - F.col("unique_prompts")
    failed = (F.col("total_records") > 0) & ((F.col("placeholder_choice_count") > 0) | (duplicates / total > 0.25) | (F.col("most_one_reference") / total > MOST_ONE_REFERENCE))
    empty = {c: F.lit("") for c in ("text", "response") if c not in rows.columns}
    return bundle_heuristics(rows.withColumns(empty)).select(F.col("total_records").alias("total_cases"), duplicates.alias("duplicate_prompt_count"), "placeholder_choice_count", (F.col("most_one_reference") / total).alias("max_reference_ratio"), failed.alias("quality_failed"))


def fetch_gate(sources: DataFrame, least: int, metadata_only: bool = False) -> DataFrame:
    """Counts of sources by status; fewer sampled ones than `least` are an error, unless only metadata was asked for."""
    totals = sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("status") == "sampled").alias("sampled_sources"), F.count_if(F.col("status") == "error").alias("failed_sources"))
    if metadata_only:
        return totals
    said = F.concat(F.lit("too few sources were sampled: "), F.col("sampled_sources"), F.lit(f" < {least}"))
    return totals.withColumn("sampled_sources", F.when(F.col("sampled_sources") >= least, F.col("sampled_sources")).otherwise(F.raise_error(said).cast("long")))


def reset_guard(artifacts: DataFrame, summaries: DataFrame, statuses: DataFrame, checkpoints: DataFrame, run: str = "run", forced: bool = False) -> DataFrame:
    """run, reasons, may_reset for each run with any evidence: whether its folder may be reset.

    What forbids it: artifacts (name, size) that aren't empty, a summary (total_records), a status (train_records, val_records,
    processed_tasks) and checkpoints (train_records, val_records, processed_tasks_total) that tell of records or tasks; forced overrides.
    """
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    whole = lambda c: c.cast("string")
    records = count("train_records") + count("val_records")
    files = artifacts.groupBy(run).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("size") > 0, F.col("name")))), ", ").alias("f"))  # a few names a run
    told = summaries.groupBy(run).agg(F.max(count("total_records")).alias("s"))
    status = statuses.groupBy(run).agg(F.max(records).alias("r"), F.max(count("processed_tasks")).alias("p"))
    saved = checkpoints.groupBy(run).agg(F.max(records).alias("cr"), F.max(count("processed_tasks_total")).alias("cp"))
    every = files.join(told, run, "full").join(status, run, "full").join(saved, run, "full")
    reasons = [
        F.when(F.col("f") != "", F.concat(F.lit("non-empty artifacts: "), "f")),
        F.when(F.col("s") > 0, F.concat(F.lit("eval_summary.json reports "), whole(F.col("s")), F.lit(" records"))),
        F.when((F.col("r") > 0) | (F.col("p") > 0), F.concat(F.lit("status.json reports "), whole(F.col("p")), F.lit(" processed tasks and "), whole(F.col("r")), F.lit(" records"))),
        F.when((F.col("cr") > 0) | (F.col("cp") > 0), F.concat(F.lit("checkpoint_*.json reports up to "), whole(F.col("cp")), F.lit(" processed tasks and "), whole(F.col("cr")), F.lit(" records"))),
    ]
    said = F.concat_ws("; ", *reasons)
    return every.select(run, said.alias("reasons"), ((said == "") | F.lit(forced)).alias("may_reset"))


def chosen_stages(stages: DataFrame, only: str = "", skip: str = "", name: str = "stage") -> DataFrame:
    """Stages whose name holds one of the comma separated tags of only, if there are any, and none of skip's."""
    tags = lambda s: tuple(x for x in s.split(",") if x)
    out = stages
    if tags(only):
        out = out.where(_any(F.col(name), tags(only)))
    return out.where(~_any(F.col(name), tags(skip))) if tags(skip) else out


def first_present(places: DataFrame, key: list[str], priority: str = "priority", path: str = "path", size: str = "length") -> DataFrame:
    """For each key the path of the first place, by priority, that isn't empty; null where all are."""
    return places.groupBy(*key).agg(F.min_by(path, F.when(F.col(size) > 0, F.col(priority))).alias(path))

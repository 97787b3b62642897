"""Lane records: values as text, prompts, defaults of missing fields, supervised, benchmark and replay records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import text as T
from tessera.operators.bundles import LANES
from tessera.operators.records import canonical_json, key_values

# Fixed texts and names of the lanes: prompt before the body, bucket, task, and what stands for a missing field.
PROMPTS = {
    "detection": "Analyze the following content for moderation and safety detection.\nReturn strict JSON with keys: domain, policy_label, severity, risk_tags, rationale.\nUse concise labels and do not add extra prose.\n\nContent:\n",
    "code": "Solve the following Python task.\nReturn executable Python code only inside a fenced ```python block.\nUse Python 3.12 standard library only unless the prompt explicitly says otherwise.\n\nTask:\n",
    "math": "Solve the following math problem.\nReturn your result using <think>...</think><answer>...</answer>.\nPut only the final exact answer inside <answer>.\n\nProblem:\n",
    "stem_reasoning": "Answer the following STEM multiple-choice question.\nReturn your result using <think>...</think><answer>...</answer>.\nPut only the final option letter inside <answer>.\n\nQuestion:\n",
    "tool_use": "Select the best tool call for the following user request.\nReturn strict JSON with keys: tool_name, arguments.\nDo not add prose or markdown fences.\n\nUser request:\n",
}
TASKS = {"detection": "json_match", "code": "python_exec", "math": "exact_math", "stem_reasoning": "mcq_reasoning", "tool_use": "json_match"}
BUCKET = "gguf_{lane}_distill"
FENCES = {"python": "python", "rust2024": "rust", "rust": "rust", "go": "go", "typescript": "typescript", "ts": "typescript", "csharp": "csharp", "c#": "csharp", "cs": "csharp"}
NO_CODE, NO_VERIFIER = "def solve() -> None:\n    return None", "result = locals().get('solve')\nassert callable(result)"
NO_REASONING = {"math": "Solve the problem carefully and concisely.", "stem_reasoning": "Pick the best option and explain briefly."}
NO_CHOICES = ("A. Option A", "B. Option B", "C. Option C", "D. Option D")
NO_RATIONALE, NO_TOOL = "normalized from teacher output", "tool.call"
REPLAY_MODE, REPLAY_TEACHER = "sft_replay", "original_ltf_replay"
PROFILES = ("smoke", "v1")


def clean(c: Column) -> Column:
    """Stripped; null if nothing is left, so that coalesce() takes the next."""
    return T.truthy(T.strip_u(c))


def lane_name(value: Column) -> Column:
    """The lane that a value names (detection if null or empty); an unknown one is an error."""
    name = F.replace(F.lower(F.coalesce(clean(value), F.lit("detection"))), F.lit("-"), F.lit("_"))
    return F.when(name.isin(*LANES), name).otherwise(F.raise_error(F.concat(F.lit("unsupported lane: "), value)).cast("string"))


def profile_name(value: Column) -> Column:
    name = F.lower(F.coalesce(clean(value), F.lit(PROFILES[0])))
    return F.when(name.isin(*PROFILES), name).otherwise(F.raise_error(F.concat(F.lit("unsupported quality_profile: "), value)).cast("string"))


# Values as text.


def _spoken(turn: dict) -> str | None:
    who, said = (next((turn[k] for k in keys if turn.get(k)), "") for keys in (("role", "from"), ("content", "value")))
    return None if not said else f"{who}: {said}" if who else str(said)


def value_text(value: object, turns: bool = True) -> str:
    """Text of a JSON value: nothing for null, sorted JSON of an object, a line for each item of a list.

    With turns, a list of objects becomes paragraphs of who said what, if any of them says something.
    """
    if isinstance(value, list):
        said = [s for s in map(_spoken, value) if s] if turns and value and all(isinstance(x, dict) for x in value) else []
        return "\n\n".join(said) or "\n".join(value_text(x, turns) for x in value)
    if isinstance(value, dict):
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    return "" if value is None else str(value)


def _texts(turns: bool):
    @F.pandas_udf(StringType())
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda raw: "" if raw is None else value_text(json.loads(raw), turns))

    return texts


_with_turns, _without_turns = _texts(True), _texts(False)


def stringified(json_text: Column, turns: bool = True) -> Column:
    """value_text() of JSON texts; null is the empty text."""
    return (_with_turns if turns else _without_turns)(json_text)


def extracted(row: dict[str, Column], field: str | None = None, template: str | None = None) -> Column:
    """A template filled from the row's texts wins over a field; with neither, the empty text."""
    if template:
        return T.fill(template, row)
    return T.strip_u(F.coalesce(row[field], F.lit(""))) if field in row else F.lit("")


def choice_list(value: Column) -> Column:
    """Choices of a JSON list, of an object's A to E, or of a text's lines; four placeholders where there are none."""
    v = T.strip_u(F.coalesce(value, F.lit("")))
    kept = lambda a: F.filter(F.transform(a, T.strip_u), lambda x: x != "")
    letters = F.from_json(v, "map<string,string>")
    lettered = F.filter(F.array(*(F.concat(F.lit(f"{k}. "), clean(letters[k])) for k in "ABCDE")), lambda x: x.isNotNull())
    lines = kept(F.split(v, r"\r?\n"))
    found = F.when(v.startswith("["), kept(F.from_json(v, "array<string>"))).when(v.startswith("{"), lettered).otherwise(lines)
    return F.when((F.size(found) > 0) | v.startswith("["), found).otherwise(F.array(*map(F.lit, NO_CHOICES)))


# Examples: what a lane's record needs, with defaults.

#: The fields that each lane reads from a teacher's answer, in its JSON or in its key: value lines.
FIELDS = {
    "detection": ("input_text", "policy_label", "severity", "risk_tags", "rationale"),
    "code": ("user_request", "assistant_code", "verifier_snippet", "reference", "rationale"),
    "math": ("question", "reasoning", "final_answer", "reference", "rationale"),
    "stem_reasoning": ("question", "choices", "reasoning", "final_choice", "reference", "rationale"),
    "tool_use": ("user_request", "tool_name", "arguments", "reference", "rationale"),
}


def answered(lane: str, text: Column, parsed: Column) -> dict[str, Column]:
    """The lane's fields: those of the parsed JSON, else those of `key: value` lines of the text; null where neither has one."""
    lists = {"detection": ("risk_tags",), "stem_reasoning": ("choices",)}.get(lane, ())
    said = key_values(text, FIELDS[lane], lists)
    spoken = lambda f: F.to_json(F.split(said[f], ",")) if f in lists else said[f]
    return {f: F.coalesce(F.get_json_object(parsed, f"$.{f}"), spoken(f)) for f in FIELDS[lane]}


def last_number_or_zero(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(T.NUMBER), F.lit(0)), F.lit(-1)), F.lit("0"))


def completed(lane: str, fields: dict[str, Column], text: Column, task: dict[str, Column]) -> dict[str, Column]:
    """The fields with the lane's defaults. task: description, variant, domain, target_label, mode [, tool]."""
    f = {k: clean(v) for k, v in fields.items()}
    ask = F.concat_ws("\n", clean(task["description"]), F.concat(F.lit("Variant: "), clean(task["variant"])))
    why = F.coalesce(fields["rationale"], F.lit(NO_RATIONALE))
    if lane == "detection":
        compact = F.array_join(F.filter(F.transform(F.split(text, r"\r?\n"), T.strip_u), lambda x: x != ""), " ")
        body = F.coalesce(f["input_text"], F.substring(T.truthy(compact), 1, 280), F.concat(F.lit("Synthetic example for "), task["domain"]))
        benign = task["mode"] == "benign_control"
        label = F.coalesce(fields["policy_label"], F.when(benign, "allow").otherwise(task["target_label"]))
        tags = F.coalesce(F.from_json(f["risk_tags"], "array<string>"), F.when(benign, F.array(F.lit("benign"))), F.array().cast("array<string>"))
        return {"input_text": body, "policy_label": label, "severity": F.coalesce(fields["severity"], F.when(label == "allow", "low").otherwise("medium")), "risk_tags": tags, "rationale": why}
    if lane == "code":
        check = F.coalesce(f["verifier_snippet"], f["reference"], F.lit(NO_VERIFIER))
        body = F.coalesce(f["assistant_code"], T.truthy(T.unfenced(text, T.CODE_FENCED)), F.lit(NO_CODE))
        return {"user_request": F.coalesce(f["user_request"], ask), "assistant_code": body, "verifier_snippet": check, "reference": check, "rationale": why}
    if lane == "math":
        final = F.coalesce(f["final_answer"], f["reference"], last_number_or_zero(text))
        return {"question": F.coalesce(f["question"], ask), "reasoning": F.coalesce(f["reasoning"], F.lit(NO_REASONING[lane])), "final_answer": final, "reference": F.coalesce(f["reference"], final), "rationale": why}
    if lane == "stem_reasoning":
        final = F.coalesce(F.upper(f["final_choice"]), F.upper(f["reference"]), T.last_choice(text), F.lit("A"))
        return {"question": F.coalesce(f["question"], ask), "choices": choice_list(fields["choices"]), "reasoning": F.coalesce(f["reasoning"], F.lit(NO_REASONING[lane])), "final_choice": final, "reference": F.coalesce(F.upper(f["reference"]), final), "rationale": why}
    name = F.coalesce(f["tool_name"], clean(task.get("tool", F.lit(None).cast("string"))), F.lit(NO_TOOL))
    given = F.coalesce(fields["arguments"], F.lit("{}"))
    whole = lambda c: F.coalesce(c.rlike(r"(?s)^\s*\{") & F.try_parse_json(c).isNotNull(), F.lit(False))
    arguments = F.when(whole(given), given).otherwise(F.to_json(F.struct(given.alias("input"))))
    call = F.concat(F.lit('{"arguments": '), arguments, F.lit(', "tool_name": '), _json_string(name), F.lit("}"))
    return {"user_request": F.coalesce(f["user_request"], ask), "tool_name": name, "arguments": arguments, "reference": F.when(whole(fields["reference"]), fields["reference"]).otherwise(call), "rationale": why}


def _json_string(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":|\}$', "")


def prompt(lane: str, body: Column, choices: Column | None = None) -> Column:
    out = F.concat(F.lit(PROMPTS[lane]), T.strip_u(body))
    if choices is None:
        return out
    return F.concat(out, F.lit("\n\nChoices:\n"), F.array_join(F.filter(F.transform(choices, T.strip_u), lambda x: x != ""), "\n"))


def detection_response(domain: Column, e: dict[str, Column]) -> Column:
    """The labels as sorted JSON: review and medium stand for blank ones, blank tags are left out."""
    label, severity = F.coalesce(clean(e["policy_label"]), F.lit("review")), F.coalesce(clean(e["severity"]), F.lit("medium"))
    tags = F.filter(F.transform(e["risk_tags"], T.strip_u), lambda x: x != "")
    shape = F.struct(domain.alias("domain"), label.alias("policy_label"), T.strip_u(F.coalesce(e["rationale"], F.lit(""))).alias("rationale"), tags.alias("risk_tags"), severity.alias("severity"))
    return canonical_json(F.to_json(shape))


def record(rows: DataFrame, lane: str, e: dict[str, Column], task: dict[str, Column], teacher: Column, split: Column, language: Column | None = None) -> DataFrame:
    """The lane's supervised records: bucket, mode, source, task, prompt, response, reference, system, text, metadata.

    e: the completed() fields. task: domain, variant, tags. A code record's task and fence follow its language.
    """
    kind = F.lit(TASKS[lane])
    extra = {}
    if lane == "detection":
        asked, said = prompt(lane, e["input_text"]), detection_response(task["domain"], e)
        gold, extra = said, {"domain": task["domain"]}
    elif lane == "code":
        spoken = F.coalesce(F.lower(clean(F.lit(None).cast("string") if language is None else language)), F.lit("python"))
        fence = F.coalesce(F.create_map(*(F.lit(x) for pair in FENCES.items() for x in pair))[spoken], spoken)
        asked, said = prompt(lane, e["user_request"]), F.concat(F.lit("```"), fence, F.lit("\n"), F.regexp_replace(e["assistant_code"], r"(?U)\s+$", ""), F.lit("\n```"))
        gold, extra = T.strip_u(e["verifier_snippet"]), {"language": spoken}
        kind = F.when(spoken == "python", "python_exec").otherwise("code_static_spec")
    elif lane == "tool_use":
        call = F.concat(F.lit('{"tool_name": '), _json_string(T.strip_u(e["tool_name"])), F.lit(', "arguments": '), e["arguments"], F.lit("}"))
        asked, said, gold = prompt(lane, e["user_request"]), canonical_json(call), canonical_json(e["reference"])
    else:
        final = T.strip_u(e["final_answer"]) if lane == "math" else F.upper(T.strip_u(e["final_choice"]))
        asked = prompt(lane, e["question"], e.get("choices"))
        said = F.concat(F.lit("<think>"), T.strip_u(e["reasoning"]), F.lit("</think><answer>"), final, F.lit("</answer>"))
        gold = T.strip_u(e["reference"]) if lane == "math" else F.upper(T.strip_u(e["reference"]))
    told = {"lane": F.lit(lane), "task_name": task["domain"], "split": split, "teacher": teacher, "tags": task["tags"], "variant": task["variant"]} | extra
    made = rows.select("*", kind.alias("task"), asked.alias("prompt"), said.alias("response"), gold.alias("reference"), F.struct(*(c.alias(k) for k, c in told.items())).alias("metadata"), teacher.alias("source"))
    return made.withColumns({"bucket": F.lit(BUCKET.format(lane=lane)), "mode": F.lit("sft"), "system": F.lit(""), "text": T.chat_text(F.col("prompt"), F.col("response"))})


def benchmark_rows(records: DataFrame, task: Column | str) -> DataFrame:
    """prompt, reference, task, bucket, source, metadata of validation records with all of prompt, response and reference."""
    p, r = clean(F.col("prompt")), clean(F.col("response"))
    gold = clean(F.coalesce("reference", "response"))
    out = records.select(p.alias("prompt"), gold.alias("reference"), F.coalesce(clean(F.col("task")), F.lit(task) if isinstance(task, str) else task).alias("task"), "bucket", "source", "metadata", r.alias("__r"))
    return out.where("prompt IS NOT NULL AND reference IS NOT NULL AND __r IS NOT NULL").drop("__r")


def replay_text(text: Column, prompt_of: Column, response: Column) -> Column:
    """A row's text, or its prompt and response as turns; null without either."""
    return F.coalesce(clean(text), F.concat(F.lit("<|user|>\n"), clean(prompt_of), F.lit("\n<|assistant|>\n"), clean(response)))


def replay_records(rows: DataFrame, text: Column, lane: str, split: str, source: Column, bucket: str) -> DataFrame:
    """Records of older texts that are trained on again; rows without a text are left out."""
    told = F.struct(F.lit(lane).alias("lane"), F.lit(bucket).alias("task_name"), F.lit(split).alias("split"), F.lit(REPLAY_TEACHER).alias("teacher"), source.alias("source"))
    made = rows.select("*", clean(text).alias("__text"), source.alias("__source")).where("__text IS NOT NULL")
    fixed = {"bucket": bucket, "mode": REPLAY_MODE, "prompt": "", "response": "", "reference": "", "task": TASKS[lane]}
    return made.withColumn("metadata", told).withColumns({k: F.lit(v) for k, v in fixed.items()} | {"text": F.col("__text"), "source": F.col("__source")}).drop("__text", "__source")


def tag_union(tags: Column, more: Column, keep_order: bool = False) -> Column:
    """Both sets of tags, each once: sorted, or in the order of their first appearance."""
    both = F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.coalesce(more, F.array().cast("array<string>")))
    return both if keep_order else F.array_sort(both)


def diversity_hint(index: Column, salt: int, hints: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, hints)), (F.pmod(index + salt, F.lit(len(hints))) + 1).cast("int"))


def few_shot(shots: tuple[tuple[str, str], ...], question: Column, ask: str = "Question: ", answer: str = "Answer:") -> Column:
    """Worked examples as paragraphs, then the question and an open answer."""
    head = "".join(f"{ask}{q}\n{answer} {a}\n\n" for q, a in shots)
    return F.concat(F.lit(head + ask), question, F.lit(f"\n{answer}"))

"""Queries of chat rendering, record shaping and verifiers over conversations, documents and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import verifiers as V
from tessera.functions.algebra import same_function
from tessera.operators import records as R
from tessera.plans.base import query
from tessera.session import table

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')".format
_TURNS = "c AS (SELECT conv_id, turn, role, text FROM conversations)"


@query("conv_render", f"""WITH {_TURNS} SELECT conv_id, sha1(string_agg(CASE lower(role) WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE upper(role[1]) || lower(role[2:]) END
  || ': ' || {_STRIP('text')}, chr(10) || chr(10) ORDER BY turn)) AS text_sha1 FROM c WHERE {_STRIP('text')} <> '' GROUP BY 1""")  # fmt: skip
def conv_render(spark, d):
    return R.gathered(table(spark, d, "conversations")).select("conv_id", F.sha1(R.render_turns(F.col("turns"))).alias("text_sha1")).where("text_sha1 IS NOT NULL")


@query("conv_render_tags", f"""WITH {_TURNS} SELECT conv_id, sha1(string_agg('<|' || role || '|>' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS text_sha1 FROM c WHERE text <> '' GROUP BY 1""")
def conv_render_tags(spark, d):
    return R.gathered(table(spark, d, "conversations")).select("conv_id", F.sha1(R.render_turns(F.col("turns"), marked=True)).alias("text_sha1")).where("text_sha1 IS NOT NULL")


def _pairs(spark, d):
    """Each user turn with the assistant turn that follows it: an equi-join on (conversation, turn)."""
    c = table(spark, d, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    return asked.join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a")), ["conv_id", "turn"])


_PAIRS = "p AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS a FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


@query("chat_text_sft", f"""WITH {_PAIRS} SELECT conv_id, turn, 'chat' AS bucket, 'sft' AS mode, sha1('User: ' || {_STRIP('q')} || chr(10) || chr(10) || 'Assistant: ' || {_STRIP('a')}) AS text_sha1
  FROM p WHERE {_STRIP('q')} <> '' AND {_STRIP('a')} <> ''""")  # fmt: skip
def chat_text_sft(spark, d):
    out = R.sft(_pairs(spark, d), "chat", "conversations", F.col("q"), F.col("a"))
    return out.select("conv_id", "turn", "bucket", "mode", F.sha1("text").alias("text_sha1"))


@query("sft_with_system", f"""WITH {_PAIRS} SELECT conv_id, turn, sha1('System: Be brief.' || chr(10) || chr(10) || 'User: ' || {_STRIP('q')} || chr(10) || chr(10) || 'Assistant: ' || {_STRIP('a')}) AS text_sha1 FROM p WHERE {_STRIP('q')} <> '' AND {_STRIP('a')} <> ''""")
def sft_with_system(spark, d):
    out = R.sft(_pairs(spark, d), "chat", "conversations", F.col("q"), F.col("a"), F.lit(" Be brief. "))
    return out.select("conv_id", "turn", F.sha1("text").alias("text_sha1"))


@query("pref_pairs", f"""WITH {_PAIRS}, x AS (SELECT a.conv_id, a.turn, a.q, a.a AS chosen, b.a AS rejected FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2)
  SELECT conv_id, turn, sha1('User: ' || {_STRIP('q')} || chr(10) || chr(10) || 'Assistant: ' || {_STRIP('chosen')}) AS chosen_sha1, sha1('User: ' || {_STRIP('q')} || chr(10) || chr(10) || 'Assistant: ' || {_STRIP('rejected')}) AS rejected_sha1 FROM x
  WHERE {_STRIP('q')} <> '' AND {_STRIP('chosen')} <> '' AND {_STRIP('rejected')} <> ''""")  # fmt: skip
def pref_pairs(spark, d):
    p = _pairs(spark, d)
    both = p.join(p.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("a").alias("r")), ["conv_id", "turn"])
    out = R.preference(both, "pref", "conversations", F.col("q"), F.col("a"), F.col("r"))
    return out.select("conv_id", "turn", F.sha1("chosen_text").alias("chosen_sha1"), F.sha1("rejected_text").alias("rejected_sha1"))


@query("template_render", "SELECT doc_id, 'Source src in ' || lang || ': ' || source || '.' AS prompt FROM documents")
def template_render(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fill(" Source src in {lang}: {source}. ", {"lang": F.col("lang"), "source": F.col("source")}).alias("prompt"))


@query("text_projections", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'Q: ' || source || chr(10) || chr(10) || 'A: ' || lang ELSE source END AS instruction,
  'Problem: ' || source || chr(10) || chr(10) || 'Solution: ' || lang AS labelled, source || chr(10) || chr(10) || lang AS bare, upper(lang[1]) || lower(lang[2:]) || ': ' || source AS message,
  CASE WHEN length(text) >= 64 THEN sha1('# language: ' || lang || chr(10) || text) END AS code_sha1, 'User: ' || source || chr(10) || chr(10) || 'Assistant: ' || lang AS chosen FROM documents""")  # fmt: skip
def text_projections(spark, d):
    lang, source = F.col("lang"), F.col("source")
    return table(spark, d, "documents").select(
        "doc_id",
        R.instruction_output(source, F.when(lang == "en", lang).otherwise("")).alias("instruction"),
        R.pair(source, lang, ("Problem", "Solution")).alias("labelled"),
        R.pair(source, lang).alias("bare"),
        R.message(lang, source).alias("message"),
        F.sha1(R.code(lang, F.col("text"))).alias("code_sha1"),
        R.chosen_only(source, lang).alias("chosen"),
    )


@query("teacher_prompts", f"""SELECT doc_id, sha1(left(string_split({_STRIP('text')}, chr(10) || chr(10))[1], 1024)) AS prompt_sha1 FROM documents WHERE length(text) >= 32""")
def teacher_prompts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1(R.teacher_prompt(F.col("text"))).alias("prompt_sha1")).where("prompt_sha1 IS NOT NULL")


@query("answer_split", "SELECT item_id, 'What is ' || item_id || ' + 1?' AS question, '#### ' || (item_id + 1) AS reference FROM benchmark")
def answer_split(spark, d):
    raw = F.concat(F.lit("What is "), F.col("item_id"), F.lit(" + 1? #### "), F.col("item_id") + 1, F.lit("\nnote"))
    question, gold = R.answer_split(raw)
    return table(spark, d, "benchmark").select("item_id", question.alias("question"), gold.alias("reference"))


@query("benchmark_cases", f"""SELECT 'planted' AS benchmark, CASE WHEN item_id % 3 = 0 THEN 'exact_match' ELSE 'gsm8k' END AS task, sha1({_STRIP('text')}) AS prompt_sha1, item_id::VARCHAR AS reference FROM benchmark WHERE {_STRIP('text')} <> ''""")
def benchmark_cases(spark, d):
    rows = table(spark, d, "benchmark").withColumn("task", F.when(F.col("item_id") % 3 == 0, "exact_match").otherwise("unheard"))
    out = R.benchmark_cases(rows, "planted", "gsm8k", ("gsm8k", "exact_match"), F.col("text"), F.col("item_id").cast("string"))
    return out.select("benchmark", "task", F.sha1("prompt").alias("prompt_sha1"), "reference")


@query("source_wrap", "SELECT doc_id, 'org__set-' || source AS file, source AS source_repo_id, 'code' AS lane, 'sampled' AS status FROM documents")
def source_wrap(spark, d):
    """Every document as a fetched row with its source's metadata."""
    return table(spark, d, "documents").select("doc_id", T.file_safe(F.concat(F.lit("org/set-"), F.col("source"))).alias("file"), F.col("source").alias("source_repo_id"), F.lit("code").alias("lane"), F.lit("sampled").alias("status"))


@query("fetch_summary", "SELECT count(*) AS sources, count(*) FILTER (n >= 40) AS sampled, count(*) FILTER (n < 40) AS failed FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def fetch_summary(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("n") >= 40).alias("sampled"), F.count_if(F.col("n") < 40).alias("failed"))


@query("json_recovery", """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def json_recovery(spark, d):
    """props inside prose and fences, recovered and read."""
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\n"))).when(i % 3 == 1, F.concat(F.lit("x "), F.col("props"), F.lit(" y"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.get_json_object(R.json_object(raw), "$.k").cast("long").alias("k"))


@query("key_value_lines", "SELECT event_id, event_type AS kind, user_id::VARCHAR || ',' || event_id AS tags FROM events")
def key_value_lines(spark, d):
    raw = F.concat(F.lit("- Kind: "), F.col("event_type"), F.lit("\n* tags: ["), F.col("user_id"), F.lit(", "), F.col("event_id"), F.lit("]\nother: 1\nnone"))
    found = R.key_values(raw, ("kind", "tags"), ("tags",))
    return table(spark, d, "events").select("event_id", found["kind"].alias("kind"), found["tags"].alias("tags"))


# Verifiers over responses made of the benchmark's items.

_V = """v AS (SELECT item_id AS i, CASE item_id % 5 WHEN 0 THEN '<think>because it is so</think><answer>' || item_id || '</answer>' WHEN 1 THEN '<think>short</think> <answer>The answer is ' || (item_id + 1) || '.</answer>'
  WHEN 2 THEN 'no tags ' || item_id WHEN 3 THEN '<think>sorry</think><answer>I cannot help</answer>' ELSE '<think>x</think><answer>' || item_id || '</answer>' END AS r, item_id::VARCHAR AS g FROM benchmark),
 t AS (SELECT *, regexp_extract(r, '<think>(.*?)</think>\\s*<answer>(.*?)</answer>', 1) AS th, regexp_extract(r, '<think>(.*?)</think>\\s*<answer>(.*?)</answer>', 2) AS an FROM v),
 a AS (SELECT *, CASE WHEN th <> '' AND an <> '' AND length(an) <= 4 * length(th) THEN an END AS ans FROM t),
 n AS (SELECT *, regexp_extract_all(rtrim(replace(ans, ',', ''), '.'), '-?\\d+(?:\\.\\d+)?')[-1] AS num FROM a)"""


def _responses(spark, d):
    i = F.col("item_id").cast("string")
    kind = F.col("item_id") % 5
    r = (
        F.when(kind == 0, F.concat(F.lit("<think>because it is so</think><answer>"), i, F.lit("</answer>")))
        .when(kind == 1, F.concat(F.lit("<think>short</think> <answer>The answer is "), F.col("item_id") + 1, F.lit(".</answer>")))
        .when(kind == 2, F.concat(F.lit("no tags "), i))
        .when(kind == 3, F.lit("<think>sorry</think><answer>I cannot help</answer>"))
        .otherwise(F.concat(F.lit("<think>x</think><answer>"), i, F.lit("</answer>")))
    )
    return table(spark, d, "benchmark").select(F.col("item_id").alias("i"), r.alias("r"), i.alias("g"))


@query("verify_format", f"WITH {_V} SELECT i, (ans IS NOT NULL)::DOUBLE AS format, coalesce(ans, '') AS answer FROM a")
def verify_format(spark, d):
    ans = T.tagged_answer(F.col("r"))
    return _responses(spark, d).select("i", ans.isNotNull().cast("double").alias("format"), F.coalesce(ans, F.lit("")).alias("answer"))


@query("verify_gsm8k", f"WITH {_V} SELECT i, coalesce(abs(num::DOUBLE - g::DOUBLE) < 1e-6, false)::DOUBLE AS score FROM n")
def verify_gsm8k(spark, d):
    return _responses(spark, d).select("i", F.coalesce(V.gsm8k(T.tagged_answer(F.col("r")), F.col("g")), F.lit(0.0)).alias("score"))


@query("verify_exact_match", f"WITH {_V} SELECT i, (lower(coalesce(ans, r)) = g)::DOUBLE AS score FROM a")
def verify_exact_match(spark, d):
    return _responses(spark, d).select("i", V.exact_match(V.canonical_answer(F.lit("exact_match"), F.col("r")), F.col("g")).alias("score"))


@query("verify_mcq", """SELECT doc_id, (upper(['a', 'b', 'c', 'd'][(doc_id % 4 + 1)::INT]) = substr('ABCD', (doc_id % 3 + 1)::INT, 1))::DOUBLE AS score FROM documents""")
def verify_mcq(spark, d):
    i = F.col("doc_id")
    pick = F.element_at(F.array(*map(F.lit, "abcd")), (i % 4 + 1).cast("int"))
    answer = F.concat(F.lit("Not E but "), pick, F.lit("."))
    return table(spark, d, "documents").select("doc_id", V.multiple_choice(answer, F.substring(F.lit("ABCD"), (i % 3 + 1).cast("int"), F.lit(1))).alias("score"))


@query("verify_code_spec", """WITH f AS (SELECT doc_id, CASE WHEN regexp_matches(text, 'FENCE') THEN regexp_extract(text, 'FENCE', 1) ELSE text END AS t FROM documents),
  c AS (SELECT doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS code FROM f)
  SELECT doc_id, (length(code) >= 40 AND NOT regexp_matches(code, '(?i)\\b(todo|pass|return\\s+none)'))::DOUBLE AS score FROM c""".replace("FENCE", T.FENCED))
def verify_code_spec(spark, d):
    return table(spark, d, "documents").select("doc_id", V.code_static_spec(F.col("text"), F.lit("it should return the sum of both numbers")).alias("score"))


@query("verify_rewards", f"""WITH {_V}, c AS (SELECT i, r, (ans IS NOT NULL)::DOUBLE AS format, CASE WHEN ans IS NULL OR regexp_matches(ans, '(?i)\\bi cannot help') THEN 0.0 ELSE coalesce(abs(num::DOUBLE - g::DOUBLE) < 1e-6, false)::DOUBLE END AS correct FROM n)
  SELECT i, correct, format, round(0.7 * (correct * format - 0.001 * greatest(0, length(r) - 20)) + 0.3 * 0.5, 6) AS total FROM c""")  # fmt: skip
def verify_rewards(spark, d):
    """Correctness (0 for refusals) x format, a length penalty past 20 characters, 0.7 of it plus 0.3 x a model score of 0.5."""
    ans = T.tagged_answer(F.col("r"))
    correct = F.when(ans.isNull() | ans.rlike(T.REFUSAL), 0.0).otherwise(V.gsm8k(ans, F.col("g")))
    form = ans.isNotNull().cast("double")
    total = V.verifier_total(correct, form, V.length_penalty(F.col("r"), 20), V.repeat_penalty(F.col("r")))
    return _responses(spark, d).select("i", correct.alias("correct"), form.alias("format"), F.round(V.reward_total(total, F.lit(0.5), 0.3, 0.7), 6).alias("total"))


@query("repeat_penalty", """WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents), g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
  c AS (SELECT doc_id, array_to_string(w[i:(i + 4)], ' ') AS gram, count(*) AS n FROM g GROUP BY 1, 2), e AS (SELECT doc_id, sum(greatest(0, n - 3)) AS over FROM c GROUP BY 1)
  SELECT d.doc_id, coalesce(over, 0)::BIGINT AS excess FROM documents d LEFT JOIN e USING (doc_id)""")  # fmt: skip
def repeat_penalty(spark, d):
    return table(spark, d, "documents").select("doc_id", T.ngram_excess(F.col("text")).cast("long").alias("excess"))


@query("verify_json_match", "SELECT event_id, (event_id % 3 <> 0)::INT::DOUBLE AS score FROM events")
def verify_json_match(spark, d):
    """Parsed equality, whatever the spacing; every third reference has one key more."""
    spaced = F.regexp_replace("props", r"\s", "")
    reference = F.when(F.col("event_id") % 3 == 0, F.regexp_replace(spaced, r"\}$", ',"more":1}')).otherwise(spaced)
    return table(spark, d, "events").select("event_id", V.json_match(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")), reference).alias("score"))


@query("verify_tool_call", """WITH e AS (SELECT event_id, (event_id % 5 <> 0)::INT AS name, event_id % 7 = 0 AS safe, (event_type = 'click')::INT + (event_id % 3 = 1)::INT + (user_id % 2 = 0)::INT AS hits, 3 + (event_id % 7 = 0)::INT AS keys FROM events)
  SELECT event_id, round(CASE WHEN name = 1 AND hits = keys THEN 1.0 WHEN safe THEN least(0.49, 0.35 * name + 0.35 + 0.3 * hits / keys) ELSE 0.35 * name + 0.35 + 0.3 * hits / keys END, 6) AS score FROM e""")  # fmt: skip
def verify_tool_call(spark, d):
    """Calls that hit some of the wanted arguments; every fifth has another name, every seventh misses a safety argument."""
    e = table(spark, d, "events")
    safe = F.col("event_id") % 7 == 0
    call = lambda name, kind, k, u, dry: F.to_json(F.struct(name.alias("tool_name"), F.struct(kind.alias("kind"), k.alias("k"), u.alias("u"), F.when(safe, dry).alias("dry_run")).alias("arguments")))
    gold = call(F.lit("mcp.read"), F.col("event_type"), F.col("event_id") % 3, F.col("user_id") % 2, F.lit(True))
    said = call(F.when(F.col("event_id") % 5 == 0, "mcp.write").otherwise("mcp.read"), F.lit("click"), F.lit(1), F.lit(0), F.lit(False))
    return e.select("event_id", F.round(V.json_tool_call(said, gold), 6).alias("score"))


@query("symbolic_equality", """WITH e AS (SELECT event_id, event_id % 97 + 1 AS a, user_id % 89 + 1 AS b, (event_id % 3 = 0)::INT AS off FROM events), p AS (SELECT unnest([2, -5, 11, 40]) AS x, unnest([3, 7, -13, 1]) AS y)
  SELECT event_id, bool_and((x + a) * (x + a) * (y - b) = x * x * y - b * x * x + 2 * a * x * y - 2 * a * b * x + a * a * y - (a * a * b + off)) AS equal FROM e, p GROUP BY event_id""")  # fmt: skip
def symbolic_equality(spark, d):
    """A product and its expansion for each event; every third expansion is off by one. The SQL compares values at points."""
    a, b = F.col("event_id") % 97 + 1, F.col("user_id") % 89 + 1
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    product = text("(x+", a, ")^2*(y-", b, ")/sqrt(9)")
    expanded = text("(x^2*y - ", b, "*x**2 + ", 2 * a, "*x*y - ", 2 * a * b, "*x + ", a * a, "*y - ", a * a * b + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0), ")/3")
    return table(spark, d, "events").select("event_id", same_function(product, expanded).alias("equal"))


@query("reward_dispatch", """WITH e AS (SELECT event_id, ['gsm8k', 'exact_match', 'exact_math', 'mcq_reasoning', 'json_match', 'json_tool_call_match'][(event_id % 6 + 1)::INT] AS task, user_id % 10 AS v, floor(value)::BIGINT % 10 AS w FROM events)
  SELECT event_id, task, CASE WHEN event_id % 11 = 0 THEN 0.0 WHEN task = 'mcq_reasoning' THEN (v % 4 = w % 4)::DOUBLE WHEN task = 'json_tool_call_match' THEN CASE WHEN v = w THEN 1.0 ELSE 0.7 END ELSE (v = w)::DOUBLE END AS score FROM e""")  # fmt: skip
def reward_dispatch(spark, d):
    """Six tasks in turn, each with an answer that hits its reference where two numbers agree; every eleventh answer refuses."""
    e, tasks = table(spark, d, "events"), ("gsm8k", "exact_match", "exact_math", "mcq_reasoning", "json_match", "json_tool_call_match")
    task = F.element_at(F.array(*map(F.lit, tasks)), (F.col("event_id") % 6 + 1).cast("int"))
    v, w = F.col("user_id") % 10, F.floor("value") % 10
    letter = lambda n: F.substring(F.lit("ABCD"), (n % 4 + 1).cast("int"), F.lit(1))
    call = lambda n: F.concat(F.lit('{"tool_name": "mcp.x", "arguments": {"n": '), n.cast("string"), F.lit("}}"))

    def form(n, said: bool):
        text = n.cast("string")
        by = {"gsm8k": F.concat(F.lit("So it is " if said else "#### "), text), "exact_math": F.concat(F.lit("x + "), text, F.lit(" + y")) if said else F.concat(F.lit("y + "), text, F.lit(" + x"))}
        by |= {"mcq_reasoning": letter(n), "json_match": F.concat(F.lit('{"n": '), text, F.lit(".0}" if said else "}")), "json_tool_call_match": call(n)}
        out = F
        for name, column in by.items():
            out = out.when(F.col("task") == name, column)
        return out.otherwise(text)

    answer = F.when(F.col("event_id") % 11 == 0, "I'm sorry, no.").otherwise(form(v, True))
    rows = e.select("event_id", task.alias("task"), "user_id", "value")
    return rows.select("event_id", "task", F.round(V.correctness(F.col("task"), answer, form(w, False)), 6).alias("score"))


@query("verify_python_exec", "SELECT item_id, (item_id % 3 <> 0)::INT::DOUBLE AS score, NULL::DOUBLE AS lint FROM benchmark")
def verify_python_exec(spark, d):
    """Functions of the items' numbers, run with an assert; every third is off by one. A linter that isn't installed gives null."""
    i = F.col("item_id")
    answer = F.concat(F.lit("Here:\n```python\ndef f(x: int) -> int:\n    return x + "), i + (i % 3 == 0).cast("int"), F.lit("\n```"))
    score = V.python_exec(answer, F.concat(F.lit("assert f(1) == 1 + "), i), allowed=True, seconds=20)
    return table(spark, d, "benchmark").select("item_id", score.alias("score"), V.linter("no_such_linter", answer).alias("lint"))

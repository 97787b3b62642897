"""Column functions against the values they must give."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import verifiers as V
from tessera.operators import records as R


def value(spark, column, **fields):
    names = fields or {"x": ""}
    return spark.createDataFrame([tuple(names.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw", ["  a\t\tb \n\n\n\nc  ", "ｶﾞ ﬁ ½", "　x　", "plain", "", "é ñ", "e\u0301"])
def test_normalize(spark, raw):
    import re

    want = re.sub(r"\n{3,}", "\n\n", re.sub("[\t\u00a0]+", " ", unicodedata.normalize("NFKC", raw))).strip()
    assert value(spark, T.normalize(F.col("x")), x=raw) == want


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        ("short", "short"), ("!" * 20 + "a?" * 30, "low_alnum_cjk_ratio"), ("a" * 40 + "bcdefghijk" * 5, "single_char"), ("good words here, all fine. " * 4, None),
        ("abcd efgh\n" * 30 + "x" * 3, "line_repeat"), ("abcd efgh\n" * 29 + "xyz", None), ("漢字かな混じり文" * 10, None), ("x" * 500_001, "long"),
    ],
)
def test_quality_reason(spark, raw, reason):
    assert value(spark, T.quality_reason(F.col("x")), x=raw) == reason


def test_cjk_counts_twice_and_hashes_cut_at_512(spark):
    assert value(spark, T.alnum_count(F.col("x")) + T.cjk_count(F.col("x")), x="漢a!") == 3
    assert value(spark, T.prefix_hash(F.col("x")), x="a" * 600) == value(spark, T.exact_hash(F.col("x")), x="a" * 512)


@pytest.mark.parametrize(("seconds", "label"), [(5.0, "5s"), (125.0, "2m 5s"), (3725.0, "1h 2m"), (None, "-")])
def test_duration_label(spark, seconds, label):
    assert spark.createDataFrame([(seconds,)], "s double").select(T.duration_label(F.col("s")).alias("v")).first().v == label


@pytest.mark.parametrize(("response", "answer"), [("<think>abc</think> <answer>3</answer>", "3"), ("<think>a</think><answer>12345</answer>", None), ("<think> </think><answer>3</answer>", None), ("none", None)])
def test_tagged_answer(spark, response, answer):
    assert value(spark, T.tagged_answer(F.col("x")), x=response) == answer


def test_verifiers(spark):
    score = lambda f, a, g: value(spark, f(F.col("a"), F.col("g")), a=a, g=g)
    assert score(V.gsm8k, "so 1,234.", "work #### 1234") == 1 and score(V.gsm8k, "none", "3") == 0
    assert score(V.exact_math, "<think>two thirds</think><answer>3/7</answer>", "3/7") == 1
    assert score(V.mcq, "<think>it is so</think><answer>C</answer>", "c") == 1 and score(V.multiple_choice, "A or b", "B") == 1
    assert score(V.json_match, '```json\n{"b": 1.0, "a": [2]}\n```', '{"a": [2], "b": 1}') == 1 and score(V.json_match, "{", "{}") == 0
    gold = '{"tool_name": "t", "arguments": {"a": 1, "dry_run": true}}'
    assert score(V.json_tool_call, gold, gold) == 1
    assert 0 < score(V.json_tool_call, '{"tool_name": "t", "arguments": {"a": 1}}', gold) <= 0.49
    assert 0.49 < score(V.json_tool_call, '{"tool_name": "t", "arguments": {"a": 2, "b": 1}}', '{"tool_name": "t", "arguments": {"a": 1, "b": 1}}') < 1
    assert score(V.code_static_spec, "fn add(a: i32, b: i32) -> i32 { a + b } // adds", "the test should assert that it adds up") == 1
    total = value(spark, V.reward_total(V.verifier_total(F.lit(1.0), F.lit(1.0), F.lit(-0.1), F.lit(0.0)), F.lit(0.5), 0.3, 0.7))
    assert total == pytest.approx(0.7 * 0.9 + 0.3 * 0.5)
    assert value(spark, T.ngram_excess(F.col("x"), 2, 1), x="a b a b a b") == 3


def test_code_predicates():
    assert V.has_typed_callable("class A:\n def f(self, x: int) -> int: return x") and not V.has_typed_callable("def f(x) -> int: ...") and not V.has_typed_callable("def (")
    assert V.runs_assert("def t():\n assert 1\nt()") and not V.runs_assert("def t():\n assert 1") and V.runs_assert("try:\n x()\nfinally:\n assert 1")
    assert V.redefines("def f(): ...", {"f"}) and not V.redefines("def g(): ...", {"f"}) and V.redefines("def (", {"f"})
    assert V.simhash("") == 0 and V.simhash("abc abc") == V.simhash("ABC abc") != V.simhash("abd")


def test_records(spark):
    assert R._literal_chat("{'messages': [{'role': 'user', 'content': 'a'}, {'role': 'x', 'content': ''}]}") == "<|user|>\na"
    assert R._literal_chat("{'question': 'q', 'answer': 'a'}") == "q\n\na" and R._literal_chat("[1]") is None and R._literal_chat("{") is None
    assert value(spark, R.json_object(F.col("x")), x='text {"a": 1} more') == '{"a": 1}' and value(spark, R.json_object(F.col("x")), x="no } {") is None
    assert value(spark, R.instruction_output(F.col("a"), F.col("b")), a="q", b="") == "q"
    turns = F.array(F.struct(F.lit("Human").alias("role"), F.lit(" hi ").alias("content")), F.struct(F.lit("tool").alias("role"), F.lit("x").alias("content")), F.struct(F.lit("gpt").alias("role"), F.lit(" ").alias("content")))
    assert value(spark, R.render_turns(turns)) == "User: hi\n\nTool: x"
    assert value(spark, T.chat_text(F.lit(" p "), F.lit("r"), F.lit(" "))) == "User: p\n\nAssistant: r"
    question, gold = R.answer_split(F.col("x"))
    assert value(spark, F.struct(question.alias("q"), gold.alias("g")), x="How? #### 42\nend").asDict() == {"q": "How?", "g": "#### 42"}


def test_clean_text_is_the_columns_rule(spark):
    """The one-pass function against the column rules, on texts of all kinds."""
    import random

    r = random.Random(6)
    alphabet = ["a", "B", "7", " ", "\t", " ", "\n", "\n\n\n\n", "é", "ﬁ", "①", "漢", "か", "!", "?", "😀", "\x1f", "½", "ｱ"]
    texts = ["", None, "x" * 70, "!" * 100, "ab " * 30, "line one\n" * 40, "  word\n" * 29 + "word", "ｱ" * 80, "a" * 500_001, "\n\n\n", "ok then " * 20 + "\n" * 40]
    texts += ["".join(r.choices(alphabet, [r.random() for _ in alphabet], k=r.randrange(20, 400))) for _ in range(150)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    norm = T.normalize(F.col("t"))
    rows = frame.select("t", T.clean(F.col("t")).alias("c"), norm.alias("n"), T.quality_reason(norm).alias("reason")).collect()
    for x in rows:
        assert (x.c.text, x.c.reason) == (x.n, x.reason) or x.n is not None and x.c.text == x.n.strip(), repr(x.t)

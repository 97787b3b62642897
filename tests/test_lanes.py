"""Lane records, registries, checks and order within groups, on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import verifiers as V
from tessera.operators import checks, lanes, mixing, telemetry
from tessera.operators.order import with_ordinal, with_running
from tessera.sources import registry


def test_ordinals_and_sums_within_groups(spark):
    r = random.Random(3)
    rows = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", r.randrange(1, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g string, size long").repartition(5)
    groups = {}
    for i, g, size in sorted(rows):
        groups.setdefault(g, []).append((i, size))
    want = {i: (n + 1, sum(s for _, s in own[:n])) for own in groups.values() for n, (i, _) in enumerate(own)}
    assert {x.i: x.ord for x in with_ordinal(df, ["i"], ["g"]).collect()} == {i: n for i, (n, _) in want.items()}
    assert {x.i: x.before for x in with_running(df, "size", ["g"], ["i"]).collect()} == {i: s for i, (_, s) in want.items()}
    assert with_ordinal(df.limit(0), ["i"], ["g"]).count() == 0
    out = mixing.token_tail(df, "size", ["i"], 0.1).collect()
    total = sum(s for *_, s in rows)
    assert sum(x.val for x in out) == int(total * 0.1) and sum(x.train for x in out) == total - int(total * 0.1)


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (None, ""), ("a", "a"), (3, "3"), (True, "True"), ([], ""), ([1, "x"], "1\nx"), ({"b": 1, "a": "é"}, '{"a": "é", "b": 1}'),
        ([{"role": "user", "content": "hi"}, {"from": "gpt", "value": "yo"}, {"role": "x", "content": ""}], "user: hi\n\ngpt: yo"),
        ([{"content": "alone"}], "alone"), ([{"k": 1}], '{"k": 1}'), ([["a", None], "b"], "a\n\nb"),
    ],
)
def test_values_as_text(value, want):
    assert lanes.value_text(value) == want


def test_lane_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(lanes.lane_name(F.lit(" Tool-Use "))) == "tool_use" and one(lanes.lane_name(F.lit(None).cast("string"))) == "detection"
    assert one(lanes.profile_name(F.lit(""))) == "smoke"
    with pytest.raises(Exception, match="unsupported lane"):
        one(lanes.lane_name(F.lit("cooking")))


def test_choices_and_fences(spark):
    rows = [("[]", []), (None, list(lanes.NO_CHOICES)), ("{}", list(lanes.NO_CHOICES)), ('{"B": " b ", "A": "a"}', ["A. a", "B. b"]), ("x\r\n\n y", ["x", "y"])]
    got = spark.createDataFrame([(v, i) for i, (v, _) in enumerate(rows)], "v string, i int").select("i", lanes.choice_list(F.col("v")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [w for _, w in rows]
    text = F.lit("```json\n{}\n```\n```python\nx = 1\n```")
    assert tuple(spark.range(1).select(T.unfenced(text), T.unfenced(text, T.RUN_FENCED)).first()) == ("{}", "json\n{}")


def test_code_predicates():
    cases = {
        "def t():\n assert 1\nt()": True, "def t():\n assert 1": False, "if x:\n assert 1": True, "if x:\n pass\nelse:\n assert 1": False, "x = t()\ndef t():\n assert 1": False,
        "try:\n x()\nexcept E:\n assert 0": True, "class A:\n def f(self):\n  assert 1": False, "for i in y:\n with z:\n  assert i": True, "def (": False, "": False,
    }
    assert {c: V.runs_assert(c) for c in cases} == cases
    assert V.has_typed_callable("class A:\n def f(self, x: int) -> int: ...") and not V.has_typed_callable("def _f(x: int) -> int: ...") and not V.has_typed_callable("def f(x, *, y: int) -> int: ...")


def test_characters_are_counted_in_linear_time(spark):
    import time

    text = "".join(chr(0x4E00 + i % 5000) for i in range(1_000_000)) + "一" * 7
    began = time.time()
    assert spark.createDataFrame([(text,), ("",), (None,)], "t string").select(T.top_char_count(F.col("t"))).collect() == [(207,), (0,), (None,)]
    assert time.time() - began < 20


def test_ingest_reads_what_is_there(spark, tmp_path):
    (tmp_path / "coding_dataset").mkdir()
    (tmp_path / "coding_dataset/b.jsonl").write_text('{"text": "long enough to be kept by the limit of the sink"}\nbroken\n{"text": "short"}\n')
    (tmp_path / "phi35_integrated").mkdir()
    (tmp_path / "phi35_integrated/phi35_ppo_optimized_integrated.jsonl").write_text('{"original_text": "another text that is long enough to be kept"}\n')
    rows = registry.ingest(spark, f"file://{tmp_path}", registry.PRETRAIN).collect()
    assert sorted(r.stem for r in rows) == ["webdataset_coding", "webdataset_phi35"]
    assert registry.ingest(spark, f"file://{tmp_path}/none", registry.DETECTION).count() == 0
    assert len({e.stem for e in registry.PRETRAIN}) == 10 and len({e.stem for e in registry.DETECTION}) == 8
    found = registry.expanded(spark, [{"path": f"file://{tmp_path}", "type": "flat", "weight": 2.0}, {"path": "x.txt", "type": "txt"}])
    assert [e["path"].rsplit("/", 1)[-1] for e in found] == ["b.jsonl", "phi35_ppo_optimized_integrated.jsonl", "x.txt"] and found[0]["weight"] == 2.0


def test_guards_and_gates(spark):
    rows = spark.createDataFrame([("p", "t", "r", "0")] * 3 + [("q", "u", "x", "1")], "prompt string, text string, response string, reference string")
    counts = checks.bundle_heuristics(rows)
    one = checks.heuristic_gate(counts, "math").first()
    assert one.quality_failed and list(one.reasons) == ["math fallback `<answer>0</answer>` records detected"] and (one.total_records, one.unique_prompts) == (4, 2)
    assert not checks.heuristic_gate(counts, "math", allowed=True).first().quality_failed
    assert checks.case_gate(rows.drop("text", "response")).first().quality_failed
    assert not checks.case_gate(rows.limit(0).drop("text", "response")).first().quality_failed
    sources = spark.createDataFrame([("sampled",), ("error",)], "status string")
    assert checks.fetch_gate(sources, 1).first().sampled_sources == 1 and checks.fetch_gate(sources, 5, metadata_only=True).first().sampled_sources == 1
    with pytest.raises(Exception, match="too few sources"):
        checks.fetch_gate(sources, 2).collect()


def test_reset_guard_names_all_evidence(spark):
    files = spark.createDataFrame([("a", "train.jsonl", 0), ("b", "val.jsonl", 3), ("b", "train.jsonl", 9), ("c", "x", None)], "run string, name string, size long")
    summaries = spark.createDataFrame([("a", 0), ("b", 4)], "run string, total_records long")
    statuses = spark.createDataFrame([("d", 1, None, 0), ("b", 2, 3, 7)], "run string, train_records long, val_records long, processed_tasks long")
    saved = spark.createDataFrame([("b", 1, 1, 0), ("b", 5, 0, 2), ("e", 0, 0, 0)], "run string, train_records long, val_records long, processed_tasks_total long")
    got = {r.run: (r.reasons, r.may_reset) for r in checks.reset_guard(files, summaries, statuses, saved).collect()}
    assert got["a"] == got["c"] == got["e"] == ("", True)
    assert got["d"] == ("status.json reports 0 processed tasks and 1 records", False)
    assert got["b"] == ("non-empty artifacts: train.jsonl, val.jsonl; eval_summary.json reports 4 records; status.json reports 7 processed tasks and 5 records; checkpoint_*.json reports up to 2 processed tasks and 5 records", False)
    assert all(r.may_reset for r in checks.reset_guard(files, summaries, statuses, saved, forced=True).collect())


def test_panels(spark):
    events = spark.createDataFrame([("a", "train_step", 1, 0.5), ("a", "grpo_step", 2, None), ("b", "grpo_step", 3, None), ("b", "other", 4, 9.0)], "run string, event string, step long, loss double")
    assert sorted((r.run, r.step, r.loss, r.kl) for r in telemetry.training_series(events).collect()) == [("a", 1, 0.5, 0.0), ("b", 3, 0.0, 0.0)]
    files = spark.createDataFrame([("/x/slot_01", 5, 90.0), ("/x/final", 7, 100.0)], "path string, length long, modified double")
    assert sorted(map(tuple, telemetry.inventory(files, 100.0).collect())) == [("final", "milestone", 7, 0.0), ("slot_01", "rolling", 5, 10.0)]

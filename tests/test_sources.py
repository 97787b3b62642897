"""Readers, sinks and streams on files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers, sinks
from tessera.streaming import live


def test_jsonl_kinds_and_codecs(spark, tmp_path):
    import zstandard

    lines = [{"text": "one", "source": "a"}, {"text": "two"}, {"other": 1}]
    body = "\n".join(map(json.dumps, lines)) + "\n\n{not-json\n[1]\n"
    (tmp_path / "a.jsonl").write_text(body)
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "c.jsonl.zst").write_bytes(zstandard.compress(b'{"text": "z1"}\n{"text": "z2"}'))
    for name in ("a.jsonl", "b.jsonl.gz"):
        rows = readers.corpus_jsonl(spark, f"{tmp_path}/{name}").collect()
        assert sorted(r.text for r in rows if not r.parse_error) == ["one", "two"] and sum(r.parse_error for r in rows) == 3
    assert sorted(r.text for r in readers.corpus_jsonl(spark, f"{tmp_path}/c.jsonl.zst").collect()) == ["z1", "z2"]
    (tmp_path / "d.jsonl").write_text(json.dumps({"instruction": "{'problem': 'p', 'solution': 's'}"}) + "\n")
    assert readers.corpus_jsonl(spark, f"{tmp_path}/d.jsonl", "aegis_sft").first().text == "p\n\ns"
    audit = readers.audit_jsonl(spark, f"{tmp_path}/a.jsonl").collect()
    assert sum(r.parse_error for r in audit) == 1 and sum(r.text is None and not r.parse_error for r in audit) == 2
    assert {"one", "two", "{not-json", "[1]"} <= {r.text for r in readers.texts_or_lines(spark, f"{tmp_path}/a.jsonl").collect()}


def test_arrays_objects_and_whole_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert sorted(r.a for r in readers.json_array(spark, f"{tmp_path}/x.json", "a INT").collect()) == [1, 2]
    (tmp_path / "s.json").write_text('{"state": "running"}')
    assert readers.json_object(spark, f"{tmp_path}/s.json", "state STRING").first().state == "running"
    (tmp_path / "t.txt").write_text("line one\nline two")
    assert readers.whole_texts(spark, f"{tmp_path}/t.txt").first().text == "line one\nline two"
    assert [r.path.rsplit("/", 1)[1] for r in readers.gathered(spark, str(tmp_path), ("txt", "json")).collect()] == ["s.json", "t.txt", "x.json"]


def test_manifest_and_weighted_sources(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in ("x" * 20, "short", "y" * 30, "z" * 40)))
    with pytest.raises(TypeError):
        readers.manifest([{"path": "a", "colour": 1}])
    with pytest.raises(ValueError):
        readers.manifest([{"path": "a"}, {"path": "a"}])
    sources = readers.manifest([{"path": f"{tmp_path}/m.jsonl", "name": "m", "weight": 0.5, "max_docs": 2}])
    assert [(r.text[0], r.ord, r.weight) for r in readers.weighted_sources(spark, sources).orderBy("ord").collect()] == [("x", 1, 0.5), ("y", 2, 0.5)]


def test_registry_projections(spark):
    assert len(readers.registry()) == 35
    rows = spark.createDataFrame([("q" * 20, "a" * 20), ("q", None)], "query string, response string")
    assert [r.text for r in readers.projected(rows, "metamath").collect()] == [f"Problem: {'q' * 20}\n\nSolution: {'a' * 20}"]
    chat = spark.createDataFrame([('[{"from": "human", "value": "hello there, how are you"}, {"from": "gpt", "value": "fine"}]',)], "conversations string")
    assert readers.projected(chat, "toolace").first().text == "<|human|>\nhello there, how are you\n\n<|gpt|>\nfine"


def test_events_logs_and_runs(spark, tmp_path):
    run = tmp_path / "runs" / "r1"
    run.mkdir(parents=True)
    (run / "metrics.jsonl").write_text('{"ts": 1.0, "event": "run_start"}\nbroken{\n{"ts": 2.0, "event": "grpo_step", "step": 3}\n')
    assert [(r.event, r.step) for r in readers.events(spark, f"{run}/metrics.jsonl").orderBy("ts").collect()] == [("run_start", None), ("grpo_step", 3)]
    (run / "out.log").write_text("\n".join(f"line {i}" for i in range(9)))
    assert [r.value for r in readers.log_tail(spark, f"{run}/out.log", 2).collect()] == ["line 7", "line 8"]
    assert [r.run for r in readers.runs(spark, f"{tmp_path}/runs").collect()] == ["r1"]
    assert readers.distill_runs(spark, f"{tmp_path}/runs").first().has_metrics


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, "s", "t" * 40) for i in range(4)], "ord long, source string, text string")
    sinks.write_jsonl(rows, f"{tmp_path}/out", by=["source"])
    assert spark.read.json(f"{tmp_path}/out").count() == 4
    assert sinks.within_budget(rows, 100).count() == 2
    sinks.csv_report(rows, f"{tmp_path}/csv", ["ord", "missing"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["ord", "missing"]
    js, md = sinks.report(rows.agg(F.count(F.lit(1)).alias("n")), rows.select("ord"), "Audit")
    assert json.loads(js)["summary"] == {"n": 4} and "- n: 4" in md
    assert sinks.yaml_manifest([{"name": "a", "n": 1}]) == '- name: "a"\n  n: 1\n'
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a.bin").write_bytes(b"abc")
    assert sinks.spdx(sinks.file_digests(spark, f"{tmp_path}/bin"), "x")["files"]
    assert sinks.rolling_slot(7, 3) == "slot_01"


def test_required_rows(spark):
    none = spark.createDataFrame([], "chosen_text string, rejected_text string, prompt string, reference string")
    with pytest.raises(ValueError):
        readers.preference_rows(none)
    with pytest.raises(ValueError):
        readers.prompt_rows(none)


def test_streams(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "1.jsonl").write_text('{"ts": 1.0, "event": "a", "step": 1}\nbroken\n{"ts": 2.0, "event": "a", "step": 2}\n{"ts": 3.0, "event": "b", "step": 9}\n')
    stream = live.event_stream(spark, str(folder))
    latest = live.drain_to_table(live.latest_state(stream, ["event"], "ts", ["step"]), f"file://{tmp_path}/latest", f"file://{tmp_path}/latest-state")
    assert sorted((r.event, r.step) for r in latest.collect()) == [("a", 2), ("b", 9)]
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    first = lambda: live.unseen(live.event_stream(spark, str(folder)).select("event"), "event")
    live.drain(first(), out, state)
    (folder / "2.jsonl").write_text('{"ts": 4.0, "event": "b"}\n{"ts": 5.0, "event": "c"}\n')
    live.drain(first(), out, state)
    assert sorted(r.event for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    live.append_batches(live.event_stream(spark, str(folder)), f"{tmp_path}/lines", f"{tmp_path}/lines-state")
    assert spark.read.json(f"{tmp_path}/lines").count() == 5

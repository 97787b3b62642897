"""Operators on small frames with pinned values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import bundles, corpus, generators, mixing, statistics, telemetry
from tessera.operators.order import first_wins, last_n, with_ordinal


def test_cleaning_and_audit(spark):
    japanese = "これは品質の高い日本語の文章です。データの重複を確認するための例文として十分な長さがあります。さらに続きます。長さの条件も満たしています。"
    rows = [(1, japanese, "a"), (2, japanese, "a"), (3, "!!!!!!!! " * 20, "a"), (4, "A prompt of some length.\n\nA response that is long enough to be kept by the rules.", "b"), (5, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counters = {r.source: r for r in corpus.clean_counters(docs).collect()}
    assert (counters["a"].seen, counters["a"].kept, counters["a"].drop_ratio, counters["a"].drop_dup) == (3, 1, 1, 1)
    audit = {r.source: r for r in corpus.audit_by_file(corpus.audit_rows(docs, simhash=True)).collect()}
    assert (audit["a"].docs, audit["a"].low_quality, audit["a"].exact_duplicates, audit["a"].prefix_duplicates, audit["a"].simhash_duplicates) == (3, 1, 1, 1, 1)
    assert {r.doc_id for r in corpus.clean_documents(docs).collect()} == {1, 4}


@pytest.mark.parametrize(("weight", "n", "want"), [(0.5, 4, [2, 4]), (2.5, 3, [1, 1, 2, 2, 2, 3, 3]), (1.0, 3, [1, 2, 3])])
def test_weighted_repeat(spark, weight, n, want):
    rows = spark.range(1, n + 1).select(F.col("id").alias("ord"))
    assert sorted(r.ord for r in mixing.weighted_repeat(rows, weight).collect()) == want


def test_mix_targets_round_half_to_even():
    assert mixing.mix_targets(6, (0.60, 0.35, 0.05)) == (6, 4, 0) and mixing.mix_targets(0, (0.6, 0.35, 0.05)) == (0, 0, 0)
    assert mixing.split_period(0.1) == 10 and mixing.split_period(0.9) == 2


def test_budget_split_chunks_windows(spark):
    rows = spark.createDataFrame([(i, "s", 10) for i in range(6)], "i long, g string, n int")
    assert [r.i for r in mixing.byte_budget(rows, "n", ["g"], ["i"], 25).orderBy("i").collect()] == [0, 1, 2]
    text = spark.createDataFrame([("abcdefg",), ("",)], "text string")
    assert sorted(r.text for r in mixing.chunks(text, size=3).collect()) == ["abc", "def", "g"]
    tokens = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1, 2],)], "t array<int>")
    assert sorted(r.t for r in mixing.windows(tokens, "t", 2, 1).collect()) == [[1, 2], [2, 3], [3, 4]]
    assert [(r.split) for r in mixing.tail_split(rows, 0.2, ["i"]).orderBy("i").collect()] == ["train"] * 5 + ["val"]


def test_order(spark):
    rows = spark.range(100).select((99 - F.col("id")).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    assert [(r.k, r.ord) for r in with_ordinal(rows, ["k"]).orderBy("k").collect()] == [(k, k + 1) for k in range(100)]
    assert sorted((r.g, r.k) for r in first_wins(rows, ["g"], "k", []).collect()) == [(0, 0), (1, 2), (2, 1)]
    assert [r.k for r in last_n(rows, ["k"], 3).collect()] == [97, 98, 99]


def test_statistics(spark):
    cases = spark.createDataFrame([("a", i, c) for i, c in enumerate([1, 0, 1, 1, 0, 1])], "g string, place long, correct int")
    fold = statistics.fold_accuracy(cases, 3, ["g"]).first()
    assert (fold.fold_count, fold.mean) == (3, pytest.approx(2 / 3)) and 0 <= fold.ci95_low <= fold.ci95_high <= 1
    r = random.Random(1)
    data = {g: [round(r.random(), 2) for _ in range(6)] for g in "xyz"}
    long = spark.createDataFrame([("b", g, j, i, v) for j, g in enumerate(data) for i, v in enumerate(data[g])], "benchmark string, group string, group_ord long, block long, score double")
    p = {(x.left, x.right): x.p_value for x in statistics.pairwise(long, ["benchmark"]).collect()}
    for (a, b), value in p.items():
        assert value == pytest.approx(statistics.sampled_sign_flips([u - v for u, v in zip(data[a], data[b])], 0, 0))
    same = long.withColumn("score", F.lit(0.5))
    assert {x.p_value for x in statistics.pairwise(same, ["benchmark"]).collect()} == {1.0}
    q = statistics.friedman(long, ["benchmark"]).first().statistic
    s = statistics.friedman_sampled(long, ["benchmark"], permutations=50).first()
    assert s.statistic == pytest.approx(q) and 0 < s.p_value <= 1
    tied = spark.createDataFrame([("b", 0, 1.0), ("b", 0, 1.0), ("b", 0, 0.0)], "benchmark string, block long, score double")
    assert sorted(x.rank for x in statistics.block_ranks(tied, ["benchmark", "block"]).collect()) == [1.0, 2.5, 2.5]
    with pytest.raises(Exception, match="equal numbers"):
        statistics.check_paired(long.where("NOT (group = 'x' AND block = 0)"), ["benchmark"]).collect()


def test_loop_metrics_and_attempts(spark):
    cases = spark.createDataFrame([("b", 1, 0, 0), ("b", 1, 1, 1), ("b", 4, 0, 1), ("b", 4, 1, 0)], "benchmark string, L int, case_idx long, correct int")
    deep = {r.L: r for r in statistics.loop_metrics(cases, ["benchmark"]).collect()}[4]
    assert (deep.loop_gain, deep.marginal_gain, deep.self_correction_rate, deep.overthinking_rate) == (0.0, 0.0, 0.5, 0.5)
    attempts = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (1, 3, 1.0), (2, 1, 0.4)], "c long, attempt long, score double")
    assert sorted((r.c, r.attempts, r.best, r.correct) for r in statistics.best_of(attempts, ["c"]).collect()) == [(1, 2, 1.0, 1), (2, 1, 0.4, 1)]


def lane(name, rates, end=True):
    rows = [(name, i, "grpo_step", None, i, r, 1.0, r, 0.1, 0.2 if r else 0.0, 0.0, 0.0, "t") for i, r in enumerate(rates)]
    return rows + [(name, 99, "checkpoint", "final", 24, *[None] * 8)] + ([(name, 100, "run_end", None, None, *[None] * 8)] if end else [])


def test_lane_decisions(spark):
    shape = "lane string, ord long, event string, kind string, step long, correct_rate double, format_rate double, reward_mean double, reward_std double, adv_abs_mean double, kl double, clip_frac double, prompt_task string"
    rows = lane("tool", [0.0] * 25) + lane("code", [0.0] * 20 + [0.4] * 5) + lane("math", [0.4] * 25) + lane("stem", [0.9] * 25) + lane("cut", [0.5] * 25, end=False)
    out = telemetry.lane_decision(telemetry.lane_summary(spark.createDataFrame(rows, shape))).collect()
    assert {r.lane: r.classification for r in out} == {"tool": "blocked_no_reward_signal", "code": "unstable_sparse_success", "math": "promising_but_unstable", "stem": "ready_for_export_eval", "cut": "incomplete"}
    assert out[0].lane == "tool" and out[0].warnings == ["advantage_signal"] and out[-1].lane == "stem"
    strict = telemetry.lane_decision(telemetry.lane_summary(spark.createDataFrame(lane("stem", [0.9] * 25), shape)), {"strong_mean_correct_rate": 0.95})
    assert strict.first().classification == "promising_but_unstable"


@pytest.mark.parametrize(("state", "updated", "now", "want"), [("running", 100.0, 1600.0, "stalled"), ("running", 100.0, 150.0, "healthy"), ("done", None, 0.0, "complete"), ("crashed", 1.0, 9.0, "failed"), (None, None, 1.0, "unknown")])
def test_health(spark, state, updated, now, want):
    rows = spark.createDataFrame([(state, updated)], "s string, u double")
    assert rows.select(telemetry.health(F.col("s"), F.col("u"), now, 300).alias("h")).first().h == want


def test_progress_and_completion(spark):
    percent, left = telemetry.progress(F.lit(3), F.lit(10), F.lit(0.0), F.lit(30.0))
    assert tuple(spark.range(1).select(percent, left).first()) == (30.0, 70.0)
    events = spark.createDataFrame([("r", 1, "checkpoint", "final", "9"), ("r", 2, "checkpoint", "rolling", "50"), ("q", 1, "checkpoint", "final", "0")], "run string, ord long, event string, kind string, step string")
    assert {r.run: (r.final_step, r.complete) for r in telemetry.run_complete(events, 9).collect()} == {"r": (9, True), "q": (-1, False)}


def test_hash_chain_and_tampering(spark):
    import hashlib

    rows, prev = [], ""
    for i in range(4):
        body = {"ts": float(i), "action": 'say "é"', "payload": {"n": i}, "prev_hash": prev}
        own = hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
        rows.append(("log", i, str(float(i)), 'say "é"', json.dumps(body["payload"]), prev, own))
        prev = own
    shape = "log string, ord long, ts string, action string, payload string, prev_hash string, hash string"
    assert telemetry.chain_valid(spark.createDataFrame(rows, shape)).first().valid
    rows[2] = (*rows[2][:4], '{"n": 7}', *rows[2][5:])
    assert not telemetry.chain_valid(spark.createDataFrame(rows, shape)).first().valid


def test_duplicates_only_count_accepted_rows(spark):
    rows = [(1, "T one", "p1", "bad"), (2, "t  ONE", "p1", None), (3, "t one", "p2", None), (4, "t two", "P1 ", None), (5, "t three", "p2", None)]
    out = bundles.reject_duplicates(spark.createDataFrame(rows, "i long, text string, prompt string, reason string"), "i")
    assert [r.reason for r in out.orderBy("i").collect()] == ["bad", None, "duplicate_text", "duplicate_prompt", None]


def test_gate_and_generators(spark):
    records = generators.as_records(generators.generate(spark, "math", 30)).withColumn("valid", F.lit(True)).withColumn("score", F.lit(1.0))
    summary = bundles.bundle_summary(records)
    assert summary.first().total_records == 30
    low = summary.withColumn("schema_valid_rate", F.lit(0.5)).withColumn("attempted_tasks", F.lit(40))
    assert {"schema_valid_rate", "accepted_records"} <= set(bundles.gate_failures(low, 0.0, 1.0).first().failures)
    assert bundles.gate_failures(bundles.bundle_summary(records.limit(0))).first().failures == ["no accepted records"]
    again = generators.generate(spark, "tool_use", 20).collect()
    assert again == generators.generate(spark, "tool_use", 20).collect()


def test_many_pairs_are_sampled(spark):
    """Beyond sixteen blocks no row lists all sign flips."""
    rows = [("x", g, k, b, float(b % 5 + k * (b % 3))) for k, g in enumerate("ab") for b in range(40)] + [("y", g, k, b, float(b * k)) for k, g in enumerate("ab") for b in range(4)]
    long = spark.createDataFrame(rows, "benchmark string, `group` string, group_ord int, block int, score double")
    got = {r.benchmark: r.p_value for r in statistics.pairwise(long, ["benchmark"], permutations=500).collect()}
    assert got["x"] == statistics.sampled_sign_flips([-float(b % 3) for b in range(40)], 500, 1) and 0 < got["y"] <= 1
    wide = spark.createDataFrame([([0.5] * 30,)], "d array<double>").select(statistics.exact_sign_flips(F.col("d")).alias("p"))
    assert wide.first().p is None


def test_group_report_and_its_markdown(spark):
    rows = [("x", g, k, b, (b * (k + 1)) % 5 / 5) for k, g in enumerate("abc") for b in range(6)] + [("y", g, k, b, float(k)) for k, g in enumerate("ab") for b in range(3)]
    long = spark.createDataFrame(rows, "benchmark string, `group` string, group_ord int, block int, score double")
    report = statistics.group_report(long, ["benchmark"], permutations=200)
    kinds = {(r.benchmark, r.kind, r.name): r for r in report.collect()}
    assert len(kinds) == 3 + 3 + 1 + 2 + 1 and kinds["y", "pairwise", "a-b"].value == -1.0
    p = {(r.left, r.right): r.p_value for r in statistics.pairwise(long.where("benchmark = 'x'"), ["benchmark"]).collect()}
    assert all(kinds["x", "pairwise", f"{a}-{b}"].p_value == v for (a, b), v in p.items())
    omnibus = statistics.friedman_sampled(long.where("benchmark = 'x'"), ["benchmark"], 200).first()
    assert kinds["x", "omnibus", "friedman"].p_value == omnibus.p_value and kinds["x", "omnibus", "friedman"].value == pytest.approx(omnibus.statistic)
    text = {r.benchmark: r.markdown for r in statistics.report_markdown(report, ["benchmark"]).collect()}
    assert text["x"].startswith("### x\n\n| group | n | mean | sd | sem | 95% CI |\n|---|---:|---:|---:|---:|---:|\n| a | 6 | ")
    assert "\n\n| comparison | mean delta | p | method |\n" in text["x"] and "| a - b | " in text["x"] and "| Friedman | " in text["x"] and text["x"].endswith("|\n")
    assert "Friedman" not in text["y"] and "| a - b | -1.0000 | " in text["y"]

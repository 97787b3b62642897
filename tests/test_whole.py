"""Queries that must take all rows of their tables, against their SQL without its row filter or by hand."""

import random

import duckdb
import pytest

from tessera.operators import statistics
from tessera.plans import catalog

SF = "/root/testdata/sf0.01"


def by_sql(sql, tables, d=SF):
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{d}/{name}.parquet')")
    out = con.execute(sql)
    return [c[0] for c in out.description], out.fetchall()


def same(got, columns, want):
    key = lambda row: tuple(str(v) if isinstance(v, str) else float(v) for v in row)
    a, b = sorted((key([r[c] for c in columns]) for r in got), key=str), sorted(map(key, want), key=str)
    assert len(a) == len(b)
    assert all(x == pytest.approx(y, abs=2e-6) if not isinstance(x, str) else x == y for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", ["group_summary", "block_ranks", "friedman", "pairwise_deltas", "perm_exact"])
def test_statistics_take_all_events(spark, name):
    sql = catalog.oracle_sql()[name].replace("WHERE user_id < 140 ", "")
    same(catalog.queries()[name](spark, SF).collect(), *by_sql(sql, ["events"]))


def test_sampled_friedman_takes_all_events(spark):
    _, want = by_sql(catalog.oracle_sql()["friedman"].replace("WHERE user_id < 140 ", ""), ["events"])
    got = catalog.queries()["friedman_sampled"](spark, SF).collect()
    assert {r.benchmark: r.statistic for r in got} == pytest.approx({b: s for b, _, _, s in want}, abs=2e-6)


def test_sampled_statistics_take_all_complete_blocks(spark, tmp_path):
    kinds = ["click", "cart", "error", "purchase", "signup", "view"]  # six, two with the same first letter
    rows = [(i, u, k, float((u * 7 + j * 3) % 11)) for i, (u, j, k) in enumerate((u, j, k) for u in range(100) for j, k in enumerate(kinds) if u != 61 or j)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    full = [u for u in range(100) if u != 61]
    mean = {k: sum((u * 7 + j * 3) % 11 for u in full) / len(full) for j, k in enumerate(kinds)}
    got = {(r.left, r.right): r.mean_delta for r in catalog.queries()["perm_sampled"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({(a, b): mean[a] - mean[b] for a in kinds for b in kinds if a < b}, abs=2e-6)
    assert len(catalog.queries()["friedman_sampled"](spark, str(tmp_path)).collect()) == 7


def test_source_wrap_takes_all_documents(spark):
    sql = catalog.oracle_sql()["source_wrap"].replace(" WHERE doc_id % 50 = 7", "")
    columns, want = by_sql(sql, ["documents"])
    got = catalog.queries()["source_wrap"](spark, SF).collect()
    assert len(got) == 1000 and sorted(tuple(r[c] for c in columns) for r in got) == sorted(want)


def test_stage_fill_takes_all_events_and_fills_the_rest(spark, tmp_path):
    columns, want = by_sql(catalog.oracle_sql()["stage_fill"].replace(" WHERE user_id % 25 < 20", ""), ["events", "nation"])
    got = catalog.queries()["stage_fill"](spark, SF).collect()
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want) and "marker" not in {r.status for r in got}
    spark.createDataFrame([(1, 0, "view"), (2, 24, "click"), (3, 49, "error")], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(0, "a"), (1, "b"), (24, "c")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert {(r.stage, r.status) for r in catalog.queries()["stage_fill"](spark, str(tmp_path)).collect()} == {("a", "view"), ("b", "marker"), ("c", "error")}


def test_code_in_fences_is_scored(spark, tmp_path):
    code = "def total(a, b):\n    result = a + b\n    return result"
    texts = [f"Here it is:\n```python\n{code}\n```\nwith nothing left as todo", "It is long enough by itself but here is all of it:\n```\nx\n```", code, f"```python\n{code}  # todo\n```"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.score for r in catalog.queries()["verify_code_spec"](spark, str(tmp_path)).collect()} == {0: 1.0, 1: 0.0, 2: 1.0, 3: 0.0}


def test_code_is_run_and_linted_for_all_items(spark):
    columns, want = by_sql(catalog.oracle_sql()["verify_python_exec"], ["benchmark"])
    got = catalog.queries()["verify_python_exec"](spark, SF)
    assert got.columns == columns == ["item_id", "score", "lint"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and {score for _, score, _ in want} == {0.0, 1.0}


def test_sampled_statistics_take_their_10000_permutations(spark):
    from statistics import mean

    r = random.Random(4)
    for diffs in ([r.gauss(0.2, 1) for _ in range(40)], [float(r.randrange(-3, 5)) for _ in range(25)]):
        generator, observed = random.Random(7), abs(mean(diffs))
        extreme = sum(abs(mean([d if generator.random() < 0.5 else -d for d in diffs])) >= observed - 1e-12 for _ in range(3000))
        assert statistics.sampled_sign_flips(diffs, 3000, 7) == (1 + extreme) / 3001
    for name in ("perm_sampled", "friedman_sampled"):
        p = [x.p_value * 10_001 for x in catalog.queries()[name](spark, SF).collect()]
        assert p and all(abs(x - round(x)) < 0.006 for x in p)

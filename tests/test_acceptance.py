"""Ordered acceptance against a walk over the rows."""

import random

import pytest

from tessera.operators import bundles as B


def walk(rows):
    texts, prompts, out = set(), set(), {}
    for n, text, prompt, reason in sorted(rows):
        t, p = " ".join((text or "").lower().split()), " ".join((prompt or "").lower().split())
        if reason is None:
            reason = "duplicate_text" if t in texts else "duplicate_prompt" if p in prompts else None
            if reason is None:
                texts.add(t)
                prompts.add(p)
        out[n] = reason
    return out


def found(spark, rows):
    frame = spark.createDataFrame(rows, "n long, text string, prompt string, reason string").repartition(3)
    return {r.n: (r.reason, r["round"]) for r in B.reject_duplicates(frame, "n").collect()}


def test_a_refused_row_blocks_nothing(spark):
    got = found(spark, [(1, "t1", "p1", None), (2, "t2", "p1", None), (3, "t2", "p3", None)])
    assert {n: r for n, (r, _) in got.items()} == {1: None, 2: "duplicate_prompt", 3: None}


@pytest.mark.parametrize("seed", range(4))
def test_random_chains_are_walked_alike(spark, seed):
    r = random.Random(seed)
    keys = [6, 20, 60, 200][seed]
    rows = [(n, r.choice(["T", "t "]) + f"  {r.randrange(keys)}", f"p{r.randrange(keys)}", r.choice([None] * 9 + ["short"])) for n in range(260)]
    rows += [(300, None, None, None), (301, "", "x", None), (302, "y", "", None)]
    got = found(spark, rows)
    assert {n: reason for n, (reason, _) in got.items()} == walk(rows)
    assert all((number is None) == (reason is not None) for reason, number in got.values())


def test_an_alternating_chain_takes_a_round_a_link(spark):
    rows = [(n, f"t{n // 2}", f"p{(n + 1) // 2}", None) for n in range(9)]
    got = found(spark, rows)
    assert {n: reason for n, (reason, _) in got.items()} == walk(rows)
    assert max(number or 0 for _, number in got.values()) == 5


def test_an_empty_table(spark):
    assert B.reject_duplicates(spark.createDataFrame([], "n long, text string, prompt string, reason string"), "n").count() == 0

"""The entry point, whole or without its optional parts."""

import builtins
import importlib
import sys

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_golden_values_of_cleaning(spark):
    rows = entry.entry(spark).collect()
    assert (sum(r.seen for r in rows), sum(r.kept for r in rows), sum(r.drop_short for r in rows), sum(r.drop_dup for r in rows)) == (200, 182, 7, 11)


def test_entry_without_the_optional_parts(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tessera.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.import_module

    def missing(name, *args):
        if name.startswith("tessera.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name="tessera.llm" if name.startswith("tessera") else name)
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert builtins.len(entry.oracle_sql()) > 60

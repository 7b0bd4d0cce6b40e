import importlib

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_llm_package(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "pairloom.llm", None)
    monkeypatch.setitem(sys.modules, "pairloom.llm.queries", None)
    fresh = importlib.reload(entry)
    assert "p6_found" in fresh.queries() and "p1_percentiles" not in fresh.queries()
    monkeypatch.undo()
    importlib.reload(entry)

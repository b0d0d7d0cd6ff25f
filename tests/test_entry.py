"""Driver contract: entry runs, every query has a callable, oracle keys are queries."""
import sys

import pytest

import __spark_entry__ as E
from quarterlens.plans import catalog


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "SCORE" in df.columns


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50


@pytest.mark.parametrize("missing", ["quarterlens.llm", "quarterlens.llm.queries", "corpus_pipeline"])
def test_entry_without_optional_parts(monkeypatch, missing):
    """A part that can't be imported takes only its own queries away."""
    for name in [m for m in sys.modules if m == missing or m.startswith(missing + ".")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)  # importing it raises ImportError
    found, sql = E.queries(), E.oracle_sql()
    assert set(catalog.queries()) <= set(found) and set(catalog.oracle_sql()) <= set(sql)
    assert "pipeline" not in found
    assert missing == "corpus_pipeline" or not any(name.startswith("op") and name[2].isdigit() for name in found)

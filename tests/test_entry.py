"""The registry, with and without the optional subpackage."""

import importlib
import sys

import pytest

from residua import catalog


@pytest.fixture
def without_llm(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("residua.llm") or n in ("__spark_entry__", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "residua.llm", None)
    yield importlib.import_module("__spark_entry__")
    sys.modules.pop("__spark_entry__", None)


def test_entry_works_without_the_subpackage(without_llm):
    assert set(without_llm.queries()) == set(catalog.queries())
    assert set(without_llm.oracle_sql()) == set(catalog.oracle_sql())


def test_oracles_belong_to_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_flagship_has_rows(spark):
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 1


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    import residua

    root = Path(residua.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path

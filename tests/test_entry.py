"""The driver's entry with and without the training-data subpackage."""
import importlib
import importlib.util

import __spark_entry__


def test_entry_without_training_data(monkeypatch):
    found = importlib.util.find_spec

    def without(name, *rest):
        return None if name == "shelfwise.llm" else found(name, *rest)

    monkeypatch.setattr(importlib.util, "find_spec", without)
    names = __spark_entry__.queries()
    assert "category_baseline" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
    assert not [n for n in __spark_entry__.oracle_sql() if n not in names]


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every registered query of the engine at the smallest scale, against its SQL where there is one."""

import pytest
from oracle import SF, same_rows

from recordcheck.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE_SQL:
        same_rows(spark, QUERIES[name], ORACLE_SQL[name])
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry_imports_without_llm(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("recordcheck.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "recordcheck.llm", None)
    entry = importlib.reload(__spark_entry__)
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(ORACLE_SQL)

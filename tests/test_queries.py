"""Every query of the catalog runs; those with SQL agree with DuckDB in names and values."""

import pytest

from lexweave import catalog
from tests.duck import connect, rows


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, data, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    if name in catalog.SQL:
        want = connect(data).sql(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_entry_module_without_the_training_subpackage(spark, data, monkeypatch):
    import importlib
    import sys

    for k in [k for k in sys.modules if k.startswith(("lexweave.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__

    fresh = importlib.reload(__spark_entry__)
    assert set(fresh.queries()) == set(catalog.QUERIES)
    assert set(fresh.oracle_sql()) <= set(fresh.queries())
    assert fresh.entry(spark).count() > 0
    monkeypatch.undo()
    importlib.reload(__spark_entry__)

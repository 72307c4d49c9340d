import pytest
from conftest import SF
from oracle import same

from tesserine import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.SQL[name], SF)


def test_every_query_runs(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.SQL)):
        assert catalog.QUERIES[name](spark, SF).count() > 0, name


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_without_the_corpus_operators(spark, monkeypatch):
    """The entry module works where the corpus operators and the pipeline are gone."""
    import sys

    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.startswith("tesserine.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tesserine.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(e.queries()) == set(catalog.QUERIES)

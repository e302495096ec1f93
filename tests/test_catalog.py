import pytest
from conftest import DATA
from oracle import same

from tidemark.plans.wire import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    same(QUERIES[name](spark, DATA), SQL[name], DATA)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_text_operators(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert set(entry.queries()) == set(QUERIES)

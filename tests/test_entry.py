"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 150


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 40

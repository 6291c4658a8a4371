"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_flagship_runs(spark, data_dir):
    df = entry.entry(spark)
    assert df.columns == ["qid", "doc_id", "rank", "score"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

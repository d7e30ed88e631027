import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_queries_and_sql_fit_together():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0

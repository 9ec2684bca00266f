"""Every query that has SQL against DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from ripplet import catalog
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

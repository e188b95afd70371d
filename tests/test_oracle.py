"""Every registered query against its DuckDB text on the smallest tables."""

import __spark_entry__ as entry
import compare
import pytest

QUERIES = {k: v for k, v in entry.queries().items() if k not in entry.CORPUS_QUERIES}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k not in entry.CORPUS_QUERIES}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert compare.differences(df, compare.connect(sf_dir), ORACLES[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0

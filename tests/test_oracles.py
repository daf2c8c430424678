"""Every query against DuckDB on the same files."""

import pytest

import __spark_entry__ as entry
from buildlens.plans import catalog
from tests.compare import differences, duck


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", catalog.names())
def test_query(spark, folder, con, name):
    df = entry.queries()[name](spark, folder)
    assert differences(df, con, entry.oracle_sql()[name]) == []


def test_entry(spark, folder):
    assert entry.entry(spark).count() > 0

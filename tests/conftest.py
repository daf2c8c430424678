from pathlib import Path

import pytest

from buildlens.session import local_session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not Path(FOLDER).exists():
        pytest.skip("the given tables are not there")
    return FOLDER


@pytest.fixture
def rows(spark):
    """A DataFrame from tuples and a schema text."""
    def make(data, schema):
        return spark.createDataFrame(data, schema)

    return make

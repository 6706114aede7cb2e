"""Queries that SQL can express, against DuckDB."""

import pytest

from compare import differences, duck
from courtside.llm import registered

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(registered.ORACLE_SQL))
def test_matches_sql(spark, connection, name):
    assert differences(registered.QUERIES[name](spark, SF_DIR), connection, registered.ORACLE_SQL[name]) is None

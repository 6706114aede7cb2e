"""Every registered query of the match library against its SQL, at the smallest scale. The
text operators have tests of their own."""

import pytest

import __spark_entry__ as driver
from compare import differences, duck
from courtside.plans.oracle import ORACLE_SQL
from courtside.plans.registered import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(driver.queries())
    assert set(ORACLE_SQL) <= set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, connection, name):
    assert differences(driver.queries()[name](spark, SF_DIR), connection, driver.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert driver.entry(spark).limit(1).count() == 1

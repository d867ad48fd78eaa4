"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from compare import difference, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_agrees_with_its_sql(spark, con, name):
    assert difference(entry_point.queries()[name](spark, FOLDER), con, entry_point.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert entry_point.queries()[name](spark, FOLDER).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_declared_schemas_are_those_of_the_files(spark):
    from tideline.plans.standins import SCHEMAS, table

    for name in SCHEMAS:
        assert table(spark, FOLDER, name).dtypes == spark.read.parquet(f"{FOLDER}/{name}.parquet").dtypes


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0

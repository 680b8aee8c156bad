"""Every query of the engine against its SQL over whole tables, and the contract of the entry module."""

import pytest

import __spark_entry__ as driver
from quillstone.plans import registry
from tests.sessions import SMALL, agree


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    agree(registry.queries()[name](spark, SMALL), registry.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SMALL).collect() is not None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())

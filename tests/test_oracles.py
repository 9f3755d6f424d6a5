"""Every registered query gives the rows of its DuckDB twin."""

import pytest

import __spark_entry__ as driver
import oracle

QUERIES = {name: build for plans in driver._PLANS for name, build in plans.QUERIES.items()}
ORACLES = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(ORACLES)


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    assert oracle.differences(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == []

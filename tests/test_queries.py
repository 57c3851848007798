"""Every registered query against its SQL in DuckDB, on the smallest tables; the others run."""

import compare
import pytest

from lexloom.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, sf_dir, con, name):
    assert compare.differences(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_queries_without_sql_run(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())

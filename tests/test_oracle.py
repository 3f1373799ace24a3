"""Every registered query against its SQL in another engine, on whole tables."""

import pytest

import __spark_entry__ as entry_file
from checks import compare, registry, sql


def test_every_query_has_its_sql():
    assert set(registry.queries()) == set(sql.oracle_sql())
    assert set(registry.queries()) <= set(entry_file.queries())
    assert set(entry_file.oracle_sql()) <= set(entry_file.queries())


def test_entry_has_rows(spark):
    assert entry_file.entry(spark).count() > 0


@pytest.fixture(scope="module")
def db(sf_dir):
    return compare.database(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, sf_dir, name):
    assert name in sql.oracle_sql()
    assert compare.compare(spark, db, name, sf_dir) == []

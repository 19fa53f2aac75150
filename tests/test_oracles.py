"""Every registered query of the engine's own operators runs; those with a twin in SQL give its rows."""

import pytest

from lorewright.plans.registry import ORACLE, QUERIES

from .oracle import assert_same, connected


@pytest.fixture(scope="module")
def con(sf_dir):
    return connected(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, con, name):
    assert_same(QUERIES[name](spark, sf_dir), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry_needs_no_more_than_the_engine(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns

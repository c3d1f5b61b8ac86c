"""Every job against DuckDB, or against rows that must be there."""

import pytest

from campaign.jobs import registry

from . import compare

QUERIES, ORACLES = registry()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.views(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, sf_dir, con, name):
    compare.same(QUERIES[name](spark, sf_dir), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_searches_find_their_optimum(spark, sf_dir):
    for row in QUERIES["optimise_groups"](spark, sf_dir).collect():
        assert row["y"] < 1e-3 and abs(row["x"][0] - row["label"]) < 0.1


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"n", "percent", "state"} == set(entry.entry(spark).columns)

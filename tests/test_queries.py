"""Every registered query of the graph engine against the SQL that says the same."""

import pytest
from same import assert_same, rows

from graphloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, duck, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(name, spark, sf_dir):
    assert rows(QUERIES[name](spark, sf_dir))[1]


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "depth", "relation", "node_type"]

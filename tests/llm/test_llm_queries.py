"""The registered queries against their SQL."""

import pytest
from same import assert_same

from graphloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, duck, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_ten_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())

"""Every registered query with SQL gives the rows of that SQL."""

import oracle
import pytest
from docketry.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, con, sf_dir):
    assert oracle.differences(spark, con, QUERIES[name], SQL[name], sf_dir) == ""


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert 0 < len(rows) <= 10 and rows[0]["overall_score"] is not None


def test_a_wrong_row_is_seen(spark, con, sf_dir):
    assert oracle.differences(spark, con, QUERIES["ag01_group_count"], "SELECT o_orderstatus, count(*) + 1 AS n FROM orders GROUP BY 1", sf_dir)

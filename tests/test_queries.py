import os

import oracle
import pytest
from pointloom import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, name):
    oracle.compare(spark, con, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, oracle.DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) >= set(queries.QUERIES)
    assert __spark_entry__.entry(spark).count() > 0

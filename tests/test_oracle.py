import pytest
from oracle import same

from weftline.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, name):
    same(spark, data, QUERIES[name], SQL[name])


def test_entry_lists_every_query():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())

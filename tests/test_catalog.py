"""Every query against its SQL on another engine."""

import pytest

from swathkit.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, data, duck, same_rows):
    got = QUERIES[name](spark, data)
    want = duck.execute(ORACLE_SQL[name])
    assert same_rows(got.columns, [tuple(r) for r in got.collect()]) == same_rows([d[0] for d in want.description], want.fetchall())


def test_the_rest_runs(spark, data):
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every catalogue query against its SQL."""

import pytest

from tidewell import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, sf, same_as_sql, name):
    same_as_sql(catalogue.QUERIES[name](spark, sf), catalogue.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["pk", "score", "source", "sparse_rank", "dense_rank", "fused_rank"]
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

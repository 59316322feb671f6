import pytest

import __spark_entry__
from tamarack.plans.oracles import oracle_sql
from tamarack.plans.queries import queries
from tests.compare import same

ALL, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, data, name):
    df = ALL[name](spark, data)
    if name in SQL:
        same(df, SQL[name], data)
    else:
        assert len(df.collect()) > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(ALL)

import pytest

from ferrule.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    from ferrule.session import Engine

    df = Engine(spark, base=SF).sql("from lineitem.parquet where l_quantity > 10 group by l_returnflag select l_returnflag, count(1)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_top_k_is_no_full_sort(spark):
    from ferrule.session import Engine

    df = Engine(spark, base=SF).sql("from orders.parquet select o_orderkey order by o_orderkey limit 3")
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()

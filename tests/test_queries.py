"""Every registered query of the geometry operators against its SQL on the smallest tables."""

import math

import pytest

from framegrid import queries

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def same(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return x == y or (math.isnan(x) and math.isnan(y)) or abs(x - y) < 2e-6 * max(1, abs(x))
    return x == y


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got) == sorted(want) and len(got) == len(want)
    cols = sorted(got)
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    for c in cols:
        assert all(same(x, y) for x, y in zip(a[c], b[c], strict=True)), c


def test_entry_module(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 320
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_plan_prunes_and_combines(spark, sf_dir):
    plan = queries.resample_linear_2d(spark, sf_dir)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in plan
    assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan

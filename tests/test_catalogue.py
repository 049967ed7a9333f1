"""Every query against its SQL at the smallest size."""

import pytest
from compare import differences, views
from hitloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, con, name):
    assert not differences(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], SF, con)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "session_id" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())

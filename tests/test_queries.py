"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from workload import QUERIES
from workload.check import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in entry.oracle_sql():
        assert differences(got, con.sql(entry.oracle_sql()[name]).df()) is None
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

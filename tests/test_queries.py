"""Every query of the sequence operators against its SQL."""

import pytest

from compare import assert_same, connection
from seqlattice.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    got = core.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0 or name == "x2_monotone_schemes"
    assert_same(got, duck.sql(core.ORACLE[name]).df())


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(core.ORACLE)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

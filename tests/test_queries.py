"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from shelfvoice.plans import catalog
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(catalog.queries()) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


# Built lazily: names only, no session is needed to collect them.
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    assert differences(queries()[name](spark, SF), con, oracle_sql()[name]) == []

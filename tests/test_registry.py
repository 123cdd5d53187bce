"""Every registered query against its SQL on the smallest given tables."""

import pytest

from registry.all import QUERIES, oracles
from registry.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, name, SF) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracles())

"""Every registered query against its SQL, on the smallest tables."""

import pytest

from siftgraph.plans.queries import ORACLES, QUERIES
from tests.compare import assert_same, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1

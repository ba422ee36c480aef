"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from cairn import registry
from tests.oracle import same, views

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES) and registry.FLAGSHIP in ORACLES

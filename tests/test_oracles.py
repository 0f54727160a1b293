"""Every registered core query against its SQL on the smallest tables."""

import pytest

from compare import database, difference

from memloom.plans import registry

SF = "/root/testdata/sf0.001"
EMPTY_OK = {"missing_embeddings", "on_this_day"}


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, con, name):
    found = difference(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])
    assert found is None or (found == "no rows" and name in EMPTY_OK)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0

"""Every registered query runs, and gives what its SQL gives, on the smallest tables."""

import os

import pytest

from lacuna.plans import kept, lists, registry, served, stages, triage
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
MODULES = (triage, lists, stages, served, kept)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    query = registry.QUERIES[name]
    if name in registry.ORACLES:
        assert not differences(spark, con, name, query, registry.ORACLES[name], SF)
    else:
        assert query(spark, SF).toArrow().num_rows > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

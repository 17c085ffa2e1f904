"""Every core query against its SQL on the smallest tables."""

import compare
import pytest
from lodestack.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, con, name):
    assert compare.differences(spark, con, name, registry.queries()[name], registry.oracle_sql()[name], SF) == ""

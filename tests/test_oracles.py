"""Every registered query against its check SQL on the smallest tables."""

import pytest

from gradeloom import catalog
from tests.oracle import compare, duck

catalog.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    if name in catalog.CHECKS:
        ok, note = compare(catalog.QUERIES[name], catalog.CHECKS[name], spark, SF, con)
        assert ok, note
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0

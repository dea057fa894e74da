"""Every registered query against its SQL check on the smallest tables."""

import functools

import pytest
from oracle_check import connect, differences

from mosarea.plans import catalog, catalog_validate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.fixture(scope="module", autouse=True)
def compared_once():
    """Nine queries start from the same comparison of seven estimators: built once for the tests."""
    original = catalog_validate.combined
    catalog_validate.combined = functools.cache(original)
    yield
    catalog_validate.combined = original


def test_every_check_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sql):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    assert list(ours.columns)
    if name in catalog.ORACLES:
        theirs = sql.execute(catalog.ORACLES[name]).df()
        assert differences(ours, theirs) is None
    else:
        assert len(ours) > 0

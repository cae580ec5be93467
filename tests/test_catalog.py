"""Every registered query against its check statement on the smallest tables."""

import os

import pytest
from compare import compare, duck

from sortdesk.plans import catalog

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
CHECKS = catalog.checks()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    query = catalog.queries()[name]
    if name not in CHECKS:
        assert query(spark, SF_DIR).count() > 0
        return
    same, _, diff = compare(spark, SF_DIR, query, CHECKS[name], con)
    assert same, diff


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["decision_reason", "n"] and df.count() > 5

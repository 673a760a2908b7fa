"""Every registered query with an SQL twin, whole result against whole result."""

import os

import pytest

from cohortlift.plans import catalog
from cohortlift.plans.catalog import ORACLES, QUERIES
from tools.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


#: minutes of fits without a twin; their operators are tested on small tables in test_evaluation.py
LONG = set() if os.environ.get("TEST_LONG") else set(catalog.LONG)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LONG))
def test_query_matches_its_twin(spark, con, name):
    ok, message = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert ok, message


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

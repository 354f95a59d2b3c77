"""Every query with a SQL twin against it; the others for rows and schema."""

import pytest

from citegrid.plans import registry
from tests.oracle import assert_same

QUERIES, TWINS = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), TWINS[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0

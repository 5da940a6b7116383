"""Every query with a SQL twin gives the twin's rows; those without give some."""

from __future__ import annotations

import oracle
import pytest

from tessera.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, sf, con, name):
    assert oracle.differences(registry.QUERIES[name](spark, sf), con, registry.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert not set(registry.ORACLE_SQL) - set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES

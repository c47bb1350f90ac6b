"""Every registered query of the catalogue against its SQL; those without SQL give rows or are tested elsewhere."""

from __future__ import annotations

import os

import pytest

from oracle import compare
from tessella.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(QUERIES[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)

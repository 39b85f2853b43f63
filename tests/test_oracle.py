"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as e
from pagemill import catalog
from conftest import SMALL
from oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(catalog.QUERIES) <= set(e.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, catalog.QUERIES[name], catalog.SQL[name], SMALL) == ""


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["page_id", "match_ord", "text", "href"]
    assert df.count() == 281

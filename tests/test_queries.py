"""Every query with SQL gives the same rows in DuckDB, on the smallest tables; the others give rows."""

import pytest

import verify
from lakeweave import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return verify.oracle(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    said = verify.compare(spark, con, name, SF)
    assert said.startswith(("ok", "rows only")), said


def test_entry_lists():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())

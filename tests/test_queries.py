import pytest

from tests.oracle import check
from waymark.plans import more_queries, queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.SQL[name], FOLDER)


def test_entry_imports_and_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "forward_geocode" in e.queries()

import pytest

from slatework.plans.catalogue import ORACLE_SQL, QUERIES

from .compare import expected, given

FOLDER = "/root/testdata/sf0.001"


#: Markup with look-around that DuckDB's patterns lack; tests/test_packages.py has it.
WITHOUT_SQL = {"md_html", "sink_html_book"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) | WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    assert given(QUERIES[name](spark, FOLDER)) == expected(FOLDER, ORACLE_SQL[name])

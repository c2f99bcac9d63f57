"""Every registered query against its SQL, on whole tables."""

import os

import pytest
from oracle import connect, rows_of_spark, rows_of_sql

import __spark_entry__ as entry_points
from docsnap.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    columns, rows = rows_of_spark(entry_points.queries()[name](spark, FOLDER))
    expected_columns, expected = rows_of_sql(duck, entry_points.oracle_sql()[name])
    assert columns == expected_columns
    assert sum(rows.values()) > 0
    assert rows == expected


def test_entry(spark):
    assert set(entry_points.entry(spark).columns) == {
        "path", "status", "mtime", "previous_mtime",
    }

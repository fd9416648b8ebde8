"""Every registered query against its SQL on DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    line = check.compare(spark, duck, name, SF)
    assert line.startswith("ok") and "TYPES" not in line, line


def test_every_query_without_sql_is_known():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert {n for n in without if not n.startswith("op") and n != "pipeline"} == {"fit_topics", "train_sentiment"}


def test_entry(spark):
    assert entry.entry(spark).count() == 150

"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry_points
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
#: Queries without a SQL twin; tests of their own hold them against brute force. No other query may lack one.
ROWS_ONLY = {"pca_variance", "label_run", "cluster_run", "stream_score", "batch_score", "pipeline"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, con, name):
    verdict = compare(spark, con, name, entry_points.queries()[name], entry_points.oracle_sql().get(name), SF)
    known = name in ROWS_ONLY or name.startswith("op")
    assert verdict.startswith("ok") or known and verdict.startswith("rows only"), verdict


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["split", "target_label", "n"]

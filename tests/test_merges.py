"""Merges of revisions on a small worked store: every revision that has another before it in its group is merged with it."""

from __future__ import annotations

import datetime

import pytest

from cairnwork.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Branch 1 with revisions 1, 2 and 4, branch 2 with 3, which 4 merges; 3 is merged with 4, 2 with 3, 1 with 2."""
    folder = tmp_path_factory.mktemp("merges")
    orders = [(rev, branch, "F", datetime.datetime(2020, 1, rev)) for rev, branch in ((1, 1), (2, 1), (3, 2), (4, 1))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    cells = [(1, 10), (2, 10), (2, 11), (3, 12), (4, 12), (4, 13), (4, 13)]
    items = [(rev, cell, cell + 100, line, 1.0) for line, (rev, cell) in enumerate(cells)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


#: (a, b, origin, cell, n); of 2 and 3 nothing is common.
MERGED = {(3, 4, "ancestor", 12, 1), (3, 4, "b", 13, 2), (2, 3, "a", 10, 1), (2, 3, "a", 11, 1), (2, 3, "b", 12, 1), (1, 2, "ancestor", 10, 1), (1, 2, "b", 11, 1)}


def test_cells_of_every_merge(spark, store):
    assert sorted(map(tuple, QUERIES["dag_merged_cells"](spark, store).select("a", "b", "origin", "cell", "n").collect())) == sorted(MERGED)


def test_tiles_of_every_merge(spark, store):
    listed = sorted((a, b, origin, cell + 100, n) for a, b, origin, cell, n in MERGED if origin != "ancestor")
    assert sorted(map(tuple, QUERIES["dag_merged_tiles"](spark, store).select("a", "b", "origin", "tile", "n").collect())) == listed

"""Every query with SQL of its own gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from cairnwork.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def rows(frame: pd.DataFrame) -> list[tuple]:
    show = lambda v: "null" if pd.isna(v) else str(v) if isinstance(v, (str, bool)) or not hasattr(v, "__float__") else repr(float(v))
    return sorted(tuple(map(show, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, folder, name):
    ours, theirs = QUERIES[name](spark, folder).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_lru_counts_every_access(spark, folder):
    out = QUERIES["cache_lru_replay"](spark, folder).toPandas()
    assert out.hits.sum() + out.misses.sum() == spark.read.parquet(f"{folder}/events.parquet").count()


def test_first_fit_fills_no_segment_over_its_limit(spark, folder):
    from pyspark.sql import functions as F

    packed = QUERIES["segment_first_fit"](spark, folder)
    assert packed.groupBy("shard", "segment", "byte_offset").count().where("count > 1").count() == 0
    assert packed.agg(F.max("byte_offset")).first()[0] < 1 << 16


def test_cycles_are_found_on_the_whole_graph(spark):
    from types import SimpleNamespace

    from cairnwork.operators.graph import on_cycles
    from cairnwork.plans.policies import acyclic_check

    # A cycle of three, a path from it over 8 and 9 to a cycle of two, a loop, and ends that are on no cycle.
    edges = [(3, 2), (2, 1), (1, 3), (1, 8), (8, 9), (9, 11), (11, 12), (12, 11), (20, 20), (21, 20), (20, 19), (5, 3), (None, 1), (30, 31)]
    deps = spark.createDataFrame(edges, "source long, target long")
    assert sorted(x.node for x in on_cycles(deps).collect()) == [1, 2, 3, 11, 12, 20]
    assert acyclic_check(SimpleNamespace(deps=deps)).first().on_cycles == 6
    assert on_cycles(deps.where("target < source")).count() == 0

from __future__ import annotations

import datetime as dt

import pytest

from cairnwork.streaming import streams


@pytest.fixture
def run(spark, tmp_path):
    def go(rows, schema, build, mode):
        source = str(tmp_path / "in")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
        stream = build(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table("out").collect()

    return go


def at(minute: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1, 0, minute)


def test_metric_windows(run):
    rows = [(at(0), "m", 5.0), (at(0), "m", 80.0), (at(30), "m", 1.0)]
    got = run(rows, "ts timestamp, metric string, value double", lambda s: streams.metric_windows(s, "1 minute"), "complete")
    assert sorted((r.total, r.le_10, r.le_100) for r in got) == [(1, 1, 1), (2, 1, 2)]


def test_new_tiles(run):
    got = run([(at(0), "a"), (at(1), "a"), (at(2), "b")], "ts timestamp, payload string", streams.new_tiles, "append")
    assert sorted(r.payload for r in got) == ["a", "b"]


def test_sessions_and_alerts(run):
    rows = [(at(0), 1), (at(10), 1), (at(55), 1)]
    got = run(rows, "ts timestamp, id int", streams.sessions, "complete")
    assert sorted(r.accesses for r in got) == [1, 2]


def test_lru_hits(run):
    rows = [(i, 1, x) for i, x in enumerate("abacab")]
    got = run(rows, "seq long, cell long, item string", lambda s: streams.lru_hits(s, 2), "append")
    assert [r.hit for r in sorted(got, key=lambda r: r.seq)] == [False, False, True, False, True, False]


def test_open_transactions(run):
    rows = [(at(0), 1, "Begin"), (at(5), 1, "Commit"), (at(6), 2, "Begin")]
    got = run(rows, "ts timestamp, txn int, record_type string", streams.open_transactions, "complete")
    assert {r.txn for r in got if r.open} == {2} and len(got) == 2

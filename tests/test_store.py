from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairnwork.api import Store
from cairnwork.cli import main
from cairnwork.operators.store import matching
from cairnwork.runtime import Builder, TableResolver
from cairnwork.sources.formats import written_safetensors


def test_tiles(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    payloads = spark.createDataFrame([("a",), ("a",), ("b",), ("a",)], "payload string")
    assert store.write(payloads).count() == 4 and store.stats().first().tiles == 2
    store.write(payloads)
    assert store.stats().first().tiles == 2
    assert [(r.passed, r.tiles) for r in store.verify().collect()] == [(True, 2)]
    gone = store.tiles().where("cast(payload as string) = 'a'").select("tile_hash")
    store.delete(gone)
    assert [bytes(r.payload) for r in store.tiles().collect()] == [b"b"]


def test_a_tile_can_be_deleted_and_written_again(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    payloads = spark.createDataFrame([("a",), ("b",)], "payload string")
    hashes = store.write(payloads)
    for _ in range(2):
        store.delete(hashes)
        assert store.stats().first().tiles == 0
        store.write(payloads)
        assert store.stats().first().tiles == 2 and store.table("tiles").count() == 2
    assert Store.open(spark, store.path).has(hashes.first().tile_hash)


def test_damaged_tiles_are_set_aside_and_released(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    store.write(spark.createDataFrame([("a",)], "payload string"))
    store.append("tiles", spark.createDataFrame([("00" * 32, bytearray(b"x"), 1)], "tile_hash string, payload binary, size long"))
    assert store.quarantine() == 1 and store.quarantine() == 0 and store.stats().first().tiles == 1
    assert [(r.tile_hash, r.reason) for r in store.quarantined().collect()] == [("00" * 32, "hash mismatch")]
    store.release(store.quarantined())
    assert store.stats().first().tiles == 2 and store.quarantined().count() == 0
    assert store.recover() == {"quarantined": 1, "missing": 0}


def test_memories_come_back_and_know_each_other(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    schema = "memory_type int, key string, value string, tags array<string>, importance double, written long"
    rows = spark.createDataFrame([(1, "ab", "c", [], 0.5, 1), (2, "a", "bc", [], 0.5, 1)], schema)
    store.remember(rows)
    assert store.count() == 2 and store.count(1) == 1
    first, second = (store.by_type(k).select("id") for k in (1, 2))
    store.associate(first.crossJoin(second.withColumnRenamed("id", "other")))
    assert [r.key for r in store.associated(first).collect()] == ["a"] and [r.key for r in store.associated(second).collect()] == ["ab"]
    store.forget(first)
    assert store.count() == 1
    store.remember(rows.where("memory_type = 1"))
    assert store.count() == 2


def test_revisions_merge_and_refuse_cycles(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    root = store.commit(None, ["r"], ["tr"], 1)
    a, b = store.commit(root, ["r", "x"], ["tr", "ta"], 2), store.commit(root, ["r", "y"], ["tr", "tb"], 3)
    clash = store.commit(root, ["x"], [], 4)
    assert store.common_ancestor(a, b) == root and store.merge(a, clash, 5) == ["x"]
    merged = store.merge(a, b, 6)
    row = store.table("revisions").where(F.col("rev") == merged).collect()
    assert {r.parent for r in row} == {a, b} and row[0].cells == ["r", "x", "y"] and row[0].tiles == ["ta", "tb"]
    assert {r.ancestor for r in store.ancestors(merged).collect()} == {a, b, root}
    with pytest.raises(ValueError):
        store.add_parent(root, merged)
    assert store.commit(root, ["r"], [], 7) != store.commit(root, ["r"], [], 8) and store.exists(root) and not store.exists("none")


def test_runtime_runs_within_its_budget(spark):
    cells = spark.createDataFrame([(i, 100 * i) for i in range(1, 6)], "node long, size long")
    edges = spark.createDataFrame([(5, 4, 0), (4, 3, 1), (3, 2, 2), (2, 1, 4), (5, 9, 0)], "source long, target long, kind int")
    tiles = spark.createDataFrame([(5, 1), (5, 2), (4, 1)], "node long, tile long")
    resolver = TableResolver(cells, edges, tiles)
    asked = spark.createDataFrame([(5,)], "root long")
    assert Builder(resolver).build().execute(asked).collect() == [(5, 4, 1400, False)]
    assert Builder(resolver).budget(max_compute=3).build().execute(asked).collect() == [(5, 3, 900, True)]
    assert Builder(resolver).budget(max_compute=0).build().execute(asked).collect() == [(5, 0, 0, True)]
    assert Builder(resolver).policy(matching(F.col("tile") == 1)).build().tiles_of(cells.where("node = 5")).collect() == [(5, 1)]
    assert Builder(resolver).build().health() == {"cells": 5, "dangling": 1, "on_cycles": 0}
    plan = Builder(resolver).budget(max_bytes=950).build().prefetch(asked.toDF("target"), cells.select("node").limit(0))
    assert sorted(r.node for r in plan.collect()) == [4, 5, 9]


def test_memory(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    schema = "memory_type int, key string, value string, tags array<string>, importance double, written long"
    store.remember(spark.createDataFrame([(1, "key1", "value1", ["tag1"], 0.5, 1), (2, "key2", "value2", ["tag2"], 0.9, 2), (1, "key1", "value1", ["tag1"], 0.6, 3)], schema))
    assert [r.importance for r in store.search("KEY1").collect()] == [0.6]
    assert [r.key for r in store.search("value").collect()] == ["key2", "key1"] and store.search("tag2").count() == 1 and store.search("value", 1).count() == 1
    ids = store.search("key1").select("id")
    store.touch(ids)
    assert store.memories().where("key = 'key1'").first().access_count == 1
    store.forget(ids)
    assert store.memories().count() == 1


def test_revisions_and_collection(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    hashes = sorted(r.tile_hash for r in store.write(spark.createDataFrame([("a",), ("b",), ("c",)], "payload string")).collect())
    first = store.commit(None, ["x"], hashes[:1], 1)
    second = store.commit(first, ["y"], hashes[1:2], 2)
    assert store.head() == second and [r.ancestor for r in store.ancestors(second).collect()] == [first]
    assert store.gc() == 1 and store.gc(dry_run=False) == 1 and store.gc() == 0
    store.rollback(first, 3)
    assert store.head() == first and store.gc() == 1


def test_command_line(spark, tmp_path, capsys):
    at = str(tmp_path / "s")
    (tmp_path / "w.safetensors").write_bytes(written_safetensors([("a", "F32", [1], b"1234"), ("b", "F32", [1], b"1234")]))
    assert main([at, "init"], spark) == 0 and main([at, "import", str(tmp_path / "w.safetensors")], spark) == 0
    assert Store(spark, at).stats().first().tiles == 1 and main([at, "verify"], spark) == 0
    assert main([at, "commit", "--cells", "c", "--ts", "1"], spark) == 0 and main([at, "log"], spark) == 0
    assert main([at, "remember", "1", "k", "v", "2"], spark) == 0 and main([at, "search", "k"], spark) == 0
    assert main([at, "metrics"], spark) == 0 and main([at, "query", "rev_head", "/root/testdata/sf0.001"], spark) == 0
    assert "store_tiles_total 1" in capsys.readouterr().out
    assert main([at, "read", Store(spark, at).memories().first().id], spark) == 0 and Store(spark, at).memories().first().access_count == 1
    assert main([at, "health"], spark) == 0
    assert main([at, "gc"], spark) == 0
    assert capsys.readouterr().out.strip().endswith("1")
    assert Store(spark, at).table("memory").where(F.col("key") == "k").count() == 1

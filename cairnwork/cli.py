"""python -m cairnwork.cli STORE COMMAND ...: a store from the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import Store
from .plans.catalogue import QUERIES
from .sources import formats


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cairnwork")
    out.add_argument("store")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    commands.add_parser("import").add_argument("path")
    commands.add_parser("verify")
    commands.add_parser("stats")
    commit = commands.add_parser("commit")
    commit.add_argument("--cells", default="")
    commit.add_argument("--tiles", default="")
    commit.add_argument("--ts", type=int, required=True)
    commands.add_parser("log")
    write = commands.add_parser("remember")
    for name, kind in (("type", int), ("key", str), ("value", str), ("ts", int)):
        write.add_argument(name, type=kind)
    commands.add_parser("search").add_argument("words")
    read = commands.add_parser("read")
    read.add_argument("id")
    query = commands.add_parser("query")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("--rows", type=int, default=20)
    commands.add_parser("metrics")
    commands.add_parser("health")
    gc = commands.add_parser("gc")
    gc.add_argument("--delete", action="store_true")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("cairnwork").getOrCreate()
    if a.command == "init":
        Store.create(spark, a.store)
        return 0
    store = Store.open(spark, a.store)
    split = lambda text: [x for x in text.split(",") if x]
    if a.command == "import":
        store.write(formats.tensors(spark, a.path).select(F.col("data").alias("payload")))
    elif a.command == "verify":
        result = store.verify()
        result.show()
        return int(result.where("not passed").count() > 0)
    elif a.command == "stats":
        store.stats().show()
    elif a.command == "commit":
        print(store.commit(store.head(), split(a.cells), split(a.tiles), a.ts))
    elif a.command == "log":
        store.table("revisions").select("rev", "parent", F.size("cells").alias("cells"), F.size("tiles").alias("tiles"), "ts").orderBy(F.col("ts").desc(), "rev").show(50, truncate=False)
    elif a.command == "remember":
        store.remember(spark.createDataFrame([(a.type, a.key, a.value, [], 0.5, a.ts)], "memory_type int, key string, value string, tags array<string>, importance double, written long"))
    elif a.command == "search":
        store.search(a.words).show(50)
    elif a.command == "read":
        found = store.memories().where(F.col("id") == a.id)
        store.touch(found.select("id"))
        found.show(truncate=False)
    elif a.command == "query":
        QUERIES[a.name](spark, a.folder).show(a.rows, truncate=False)
    elif a.command == "metrics":
        stats = store.stats().first()
        counts = {"store_tiles_total": stats.tiles, "store_size_bytes": stats.bytes, "memory_entries_total": store.count(), "revision_commits_total": store.table("revisions").select("rev").distinct().count()}
        print("\n".join(f"{name} {n}" for name, n in counts.items()))
    elif a.command == "health":
        found = store.recover()
        print("\n".join(f"{name} {n}" for name, n in found.items()))
        return int(any(found.values()))
    elif a.command == "gc":
        print(store.gc(dry_run=not a.delete))
    return 0


if __name__ == "__main__":
    sys.exit(main())

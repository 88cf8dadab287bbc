"""A store on a folder of tables: thin methods over the operators. Every change appends; nothing is overwritten.

Changes that undo one another (a tile written, deleted and written again, a record forgotten and remembered) carry a
sequence number; the last one of an id counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import graph, memory, revision, store

#: The version that create() writes and open() reads.
VERSION = 2
SCHEMAS = {
    "superblock": "version int",
    "tiles": "tile_hash string, payload binary, size long",
    "states": "tile_hash string, state string, reason string, seq long",
    "memory": "id string, memory_type int, key string, value string, tags array<string>, importance double, written long, seq long",
    "touches": "id string",
    "forgotten": "id string, seq long",
    "associations": "id string, other string",
    "revisions": "rev string, parent string, cells array<string>, tiles array<string>, ts long",
    "heads": "rev string, at long",
}


class Store:
    """Tables under one path that Spark reads and writes; create() makes them empty, open() checks their version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Store:
        out = cls(spark, path)
        for name, schema in SCHEMAS.items():
            spark.createDataFrame([(VERSION,)] if name == "superblock" else [], schema).write.parquet(f"{path}/{name}")
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        out = cls(spark, path)
        found = out.table("superblock").agg(F.max("version")).first()[0]
        if found != VERSION:
            raise ValueError(f"a store of version {found}, not {VERSION}")
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        columns = [f.split()[0] for f in SCHEMAS[name].split(", ")]
        rows.select(*columns).write.mode("append").parquet(f"{self.path}/{name}")

    def _next(self, *names: str) -> int:
        """A sequence number above all in these tables."""
        return 1 + max(self.table(n).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] for n in names)

    # Tiles
    def write(self, payloads: DataFrame) -> DataFrame:
        """Stores payloads (payload) that are new and makes deleted ones visible again; returns the hash of each row."""
        asked = store.with_ids(payloads)
        fresh = store.new_tiles(payloads, self.table("tiles").select("tile_hash")).withColumns({"payload": F.col("payload").cast("binary"), "size": F.octet_length("payload").cast("long")})
        gone = self._states().where("state = 'deleted'").select("tile_hash").join(asked.select("tile_hash"), "tile_hash", "left_semi")
        self._mark(gone, "live", None)
        self.append("tiles", fresh)
        return asked.select("tile_hash")

    def _states(self) -> DataFrame:
        """(tile_hash, state, reason): the last state of each tile that ever had one."""
        return self.table("states").groupBy("tile_hash").agg(F.max_by(F.struct("state", "reason"), "seq").alias("s")).select("tile_hash", "s.*")

    def _mark(self, tile_hashes: DataFrame, state: str, reason: str | None) -> None:
        seq = self._next("states")
        self.append("states", tile_hashes.select("tile_hash").distinct().withColumns({"state": F.lit(state), "reason": F.lit(reason).cast("string"), "seq": F.lit(seq).cast("long")}))

    def tiles(self) -> DataFrame:
        return self.table("tiles").join(self._states().where("state <> 'live'").select("tile_hash"), "tile_hash", "left_anti")

    def read(self, tile_hash: str) -> DataFrame:
        return self.tiles().where(F.col("tile_hash") == tile_hash)

    def has(self, tile_hash: str) -> bool:
        return not self.read(tile_hash).select("tile_hash").isEmpty()

    def delete(self, tile_hashes: DataFrame) -> None:
        self._mark(tile_hashes, "deleted", None)

    def verify(self) -> DataFrame:
        return store.verified(self.tiles())

    def quarantine(self) -> int:
        """Sets tiles whose bytes do not give their hash aside; returns how many."""
        bad = store.mismatched(self.tiles()).select("tile_hash").distinct()
        n = bad.count()
        if n:
            self._mark(bad, "quarantined", "hash mismatch")
        return n

    def quarantined(self) -> DataFrame:
        return self._states().where("state = 'quarantined'").select("tile_hash", "reason")

    def release(self, tile_hashes: DataFrame) -> None:
        """Makes quarantined tiles visible again."""
        self._mark(self.quarantined().join(tile_hashes.select("tile_hash"), "tile_hash", "left_semi"), "live", None)

    def stats(self) -> DataFrame:
        return self.tiles().agg(F.count("*").alias("tiles"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))

    def recover(self) -> dict[str, int]:
        """Damaged tiles are set aside; listed tiles that cannot be read are counted."""
        damaged = self.quarantine()
        listed = self.table("revisions").select(F.explode("tiles").alias("tile_hash")).distinct()
        return {"quarantined": damaged, "missing": listed.join(self.tiles().select("tile_hash"), "tile_hash", "left_anti").count()}

    # Memory
    def remember(self, rows: DataFrame) -> None:
        """Rows of memory_type, key, value, tags, importance, written; the id is the hash of key and value, kept apart."""
        seq = self._next("memory", "forgotten")
        self.append("memory", rows.withColumns({"id": scalars.content_hash(F.to_json(F.struct("key", "value"))), "seq": F.lit(seq).cast("long")}))

    def memories(self) -> DataFrame:
        """The last writing of each id, with its touches folded in, without what was forgotten since."""
        last = self.table("memory").groupBy("id").agg(F.max_by(F.struct("memory_type", "key", "value", "tags", "importance", "written", "seq"), F.struct("written", "seq")).alias("m"), F.max("seq").alias("known"))
        gone = self.table("forgotten").groupBy("id").agg(F.max("seq").alias("gone"))
        rows = last.join(gone, "id", "left").where("gone is null or gone < known").select("id", "m.*").drop("seq")
        rows = rows.withColumns({"access_count": F.lit(0).cast("long"), "lifecycle": F.lit("Active"), "lang": F.lit("")})
        return memory.touch_all(rows, self.table("touches")).drop("lang")

    def count(self, memory_type: int | None = None) -> int:
        found = self.memories()
        return found.count() if memory_type is None else found.where(F.col("memory_type") == memory_type).count()

    def by_type(self, memory_type: int) -> DataFrame:
        return self.memories().where(F.col("memory_type") == memory_type)

    def search(self, words: str, memory_type: int | None = None) -> DataFrame:
        found = memory.text_search(self.memories().withColumn("lang", F.array_join("tags", "\n")), words, memory_type)
        return found.drop("lang").orderBy(F.col("importance").desc(), "id")

    def touch(self, ids: DataFrame) -> None:
        self.append("touches", ids)

    def forget(self, ids: DataFrame) -> None:
        self.append("forgotten", ids.select("id").withColumn("seq", F.lit(self._next("memory", "forgotten")).cast("long")))

    def associate(self, pairs: DataFrame) -> None:
        """Pairs (id, other) know each other from now on."""
        self.append("associations", pairs.select("id", "other"))

    def associated(self, ids: DataFrame) -> DataFrame:
        """The records one step from these ids."""
        both = self.table("associations").union(self.table("associations").select("other", "id"))
        near = both.join(ids.select("id"), "id", "left_semi").select(F.col("other").alias("id")).distinct()
        return self.memories().join(near, "id", "left_semi")

    # Revisions
    def commit(self, parent: str | None, cells: list[str], tiles: list[str], ts: int, other: str | None = None) -> str:
        """A new revision on its parent (and other, for a merge); the id covers all of it, the time too."""
        row = self.spark.createDataFrame([(parent, other, cells, tiles, ts)], "parent string, other string, cells array<string>, tiles array<string>, ts long")
        rev = row.select(scalars.content_hash(F.to_json(F.struct(F.coalesce("parent", F.lit("")).alias("p"), F.coalesce("other", F.lit("")).alias("o"), "cells", "tiles", "ts"))).alias("rev")).first().rev
        row = row.withColumn("rev", F.lit(rev))
        if parent is not None or other is not None:
            self._refuse_cycles(row.select("rev", F.explode(F.array("parent", "other")).alias("parent")).where("parent is not null"))
        self.append("revisions", row if other is None else row.union(row.withColumn("parent", F.col("other"))))
        self.append("heads", row.select("rev", F.col("ts").alias("at")))
        return rev

    def add_parent(self, rev: str, parent: str) -> None:
        """One more parent of a known revision; an error where that would close a cycle."""
        known = self.table("revisions").where(F.col("rev") == rev)
        self._refuse_cycles(self.spark.createDataFrame([(rev, parent)], "rev string, parent string"))
        self.append("revisions", known.limit(1).withColumn("parent", F.lit(parent)))

    def _refuse_cycles(self, edges: DataFrame) -> None:
        if not revision.rejected(edges, self.table("revisions")).isEmpty():
            raise ValueError("the revision would have itself behind it")

    def exists(self, rev: str) -> bool:
        return not self.table("revisions").where(F.col("rev") == rev).isEmpty()

    def head(self) -> str | None:
        return self.table("heads").agg(F.max_by("rev", F.struct("at", "rev"))).first()[0]

    def rollback(self, rev: str, at: int) -> None:
        """The head points to rev again; the log of heads keeps what it was."""
        self.append("heads", self.spark.createDataFrame([(rev, at)], SCHEMAS["heads"]))

    def ancestors(self, rev: str) -> DataFrame:
        asked = self.spark.createDataFrame([(rev,)], "rev string")
        return revision.behind(asked, self.table("revisions")).where("depth > 0")

    def common_ancestor(self, a: str, b: str) -> str | None:
        pairs, revisions = self.spark.createDataFrame([(a, b)], "a string, b string"), self.table("revisions")
        found = revision.latest_common(pairs, revisions, revisions.select("rev", "ts").distinct()).first()
        return found.ancestor if found else None

    def merge(self, a: str, b: str, ts: int) -> str | list[str]:
        """The revision that merges two: its id, or the cells that both changed since their common ancestor."""
        ancestor = self.common_ancestor(a, b)
        rows = self.table("revisions").where(F.col("rev").isin(a, b, ancestor or a)).select("rev", "cells", "tiles").distinct()
        of = {r.rev: (r.cells, r.tiles) for r in rows.collect()}  # at most three revisions
        cells, tiles = of.get(ancestor, ([], []))
        fresh = [([c for c in of[x][0] if c not in cells], [t for t in of[x][1] if t not in tiles]) for x in (a, b)]
        if clash := sorted({*fresh[0][0]} & {*fresh[1][0]}):
            return clash
        return self.commit(a, [*cells, *fresh[0][0], *fresh[1][0]], [*fresh[0][1], *fresh[1][1]], ts, b)

    def unreachable(self) -> DataFrame:
        """Tiles that neither the head nor any of its ancestors lists."""
        revisions, head = self.table("revisions"), self.head()
        edges = revision.parent_edges(revisions)
        live = graph.reachable(edges, self.spark.createDataFrame([(head,)], "node string")).select(F.col("node").alias("rev"))
        listed = revisions.join(live, "rev", "left_semi").select(F.explode("tiles").alias("tile_hash"))
        return self.tiles().select("tile_hash").join(listed, "tile_hash", "left_anti")

    def gc(self, dry_run: bool = True) -> int:
        lost = self.unreachable()
        n = lost.count()
        if not dry_run and n:
            self._mark(lost, "deleted", None)
        return n

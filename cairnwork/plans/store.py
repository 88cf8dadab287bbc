"""Queries on tiles: identity, deduplication, packing, integrity, adjacency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import content_hash
from ..operators import store
from .registry import query

_TILES = "SELECT sha256(payload) AS tile_hash, MIN(CAST(octet_length(encode(payload)) AS BIGINT)) AS size, COUNT(*) AS dedup_count FROM {tiles} WHERE payload IS NOT NULL GROUP BY 1"


def _payloads(t):
    return t.tiles.where("payload is not null")


@query("SELECT key, sha256(payload) AS tile_hash FROM {tiles}")
def tile_ids(t):
    return store.with_ids(t.tiles).select("key", "tile_hash")


@query(f"SELECT tile_hash, dedup_count FROM ({_TILES}) x WHERE dedup_count > 1")
def tile_dedup_groups(t):
    return store.deduplicated(_payloads(t)).where("dedup_count > 1").select("tile_hash", "dedup_count")


@query(f"SELECT COUNT(*) AS tiles, CAST(SUM(dedup_count) AS BIGINT) AS writes, CAST(SUM(dedup_count - 1) AS BIGINT) AS dedup_hits, CAST(SUM(size) AS BIGINT) AS stored_bytes, CAST(SUM(size * dedup_count) AS BIGINT) AS written_bytes FROM ({_TILES}) x")
def tile_store_stats(t):
    return store.store_stats(_payloads(t))


@query("SELECT DISTINCT sha256(payload) AS tile_hash, payload FROM {tiles} WHERE sha256(payload) = (SELECT sha256(text) FROM {documents} WHERE doc_id = 0)")
def tile_point_read(t):
    wanted = t.documents.where("doc_id = 0").select(content_hash(F.col("text")).alias("tile_hash"))
    return store.with_ids(t.tiles).join(F.broadcast(wanted), "tile_hash", "left_semi").select("tile_hash", "payload").dropDuplicates(["tile_hash"])


@query("SELECT DISTINCT sha256(text) AS tile_hash FROM {documents} WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM {documents} WHERE source = 'src0' AND text IS NOT NULL)")
def tile_delete(t):
    hashed = t.documents.where("text is not null").select("source", content_hash(F.col("text")).alias("tile_hash"))
    return hashed.join(hashed.where("source = 'src0'").select("tile_hash"), "tile_hash", "left_anti").select("tile_hash").distinct()


@query("SELECT DISTINCT sha256(html) AS tile_hash FROM {pages} WHERE html IS NOT NULL AND sha256(html) NOT IN (SELECT sha256(text) FROM {documents} WHERE text IS NOT NULL)")
def tile_append_new(t):
    stored = t.documents.where("text is not null").select(content_hash(F.col("text")).alias("tile_hash"))
    return store.new_tiles(t.pages.where("html is not null").select(F.col("html").alias("payload")), stored).select("tile_hash")


@query("SELECT sha256(payload) = CASE WHEN length(payload) % 97 = 0 THEN sha256(payload || 'x') ELSE sha256(payload) END AS passed, COUNT(*) AS tiles FROM {tiles} WHERE payload IS NOT NULL GROUP BY 1")
def tile_integrity(t):
    damaged = F.when(F.length("payload") % 97 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload"))
    return store.verified(_payloads(t).withColumn("tile_hash", content_hash(damaged)))


@query(f"SELECT segment, COUNT(*) AS tiles, CAST(SUM(size) AS BIGINT) AS bytes FROM (SELECT size, CAST(FLOOR((SUM(size) OVER (ORDER BY tile_hash) - size) / 1048576e0) AS BIGINT) AS segment FROM ({_TILES}) x) y GROUP BY segment")
def segment_packing(t):
    return store.segments(store.deduplicated(_payloads(t)), 1 << 20)


@query()
def segment_first_fit(t):
    tiles = store.deduplicated(_payloads(t)).withColumn("shard", F.conv(F.substring("tile_hash", 1, 3), 16, 10))
    return store.first_fit(tiles, 1 << 16)


@query(
    """SELECT p_partkey, CAST(g AS BIGINT) AS tile_no, CAST(g * per AS BIGINT) AS first_row, CAST(LEAST(per, p_size - g * per) AS BIGINT) AS n_rows
    FROM (SELECT p_partkey, p_size, GREATEST(CAST(FLOOR(65536 / (p_size * 256e0)) AS BIGINT), 1) AS per FROM {part}) x, LATERAL (SELECT UNNEST(range(0, CAST(CEIL(p_size * 1e0 / per) AS BIGINT))) AS g) s"""
)
def row_tiling_plan(t):
    sized = t.part.select("p_partkey", F.col("p_size").cast("long").alias("n"), (F.col("p_size") * 256).cast("long").alias("row_bytes"))
    return store.row_tiles(sized, "n", "row_bytes", 65536).select("p_partkey", "tile_no", "first_row", "n_rows")


@query("SELECT type_code, COUNT(*) AS n, string_agg(CAST(cell_id AS STRING), ',' ORDER BY cell_id) AS cells FROM {cells} GROUP BY type_code")
def index_by_type(t):
    cells = F.array_join(F.transform(F.array_sort(F.collect_list("cell_id")), lambda x: x.cast("string")), ",")
    return t.cells.groupBy("type_code").agg(F.count("*").alias("n"), cells.alias("cells"))


@query("SELECT dtype_code, COUNT(*) AS cells, CAST(SUM(size) AS BIGINT) AS bytes, CAST(SUM(stored_size) AS BIGINT) AS stored FROM {cells} GROUP BY dtype_code")
def index_by_dtype(t):
    return t.cells.groupBy("dtype_code").agg(F.count("*").alias("cells"), F.sum("size").alias("bytes"), F.sum("stored_size").alias("stored"))


@query("SELECT source, string_agg(CAST(target AS STRING), ',' ORDER BY target) AS targets FROM (SELECT DISTINCT source, target FROM {deps}) d GROUP BY source")
def adjacency_lists(t):
    return t.deps.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_set("target")), lambda x: x.cast("string")), ",").alias("targets"))


@query("SELECT target, COUNT(DISTINCT source) AS dependents FROM {deps} GROUP BY target")
def dependents_of(t):
    return t.deps.select("source", "target").distinct().groupBy("target").agg(F.count("*").alias("dependents"))


@query("SELECT source, COUNT(*) AS hard FROM {deps} WHERE kind IN (0, 1, 2) GROUP BY source")
def hard_dependencies(t):
    return t.deps.where(F.col("kind").isin(0, 1, 2)).groupBy("source").agg(F.count("*").alias("hard"))


@query("SELECT COUNT(*) AS tensors, CAST(SUM(size) AS BIGINT) AS bytes, CAST(SUM(CEIL(size / 65536e0)) AS BIGINT) AS tiles FROM {cells}")
def import_report(t):
    return t.cells.agg(F.count("*").alias("tensors"), F.sum("size").alias("bytes"), F.sum(F.ceil(F.col("size") / 65536)).cast("long").alias("tiles"))

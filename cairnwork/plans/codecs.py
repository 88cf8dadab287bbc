"""Queries on records and texts of fixed form: headers, manifests, JSON lines, hashes, compressed payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.scalars import content_hash
from ..operators import store
from .registry import query

_MAGIC = b"SEGMENT1"
_TILES = "SELECT sha256(payload) AS tile_hash, MIN(CAST(octet_length(encode(payload)) AS BIGINT)) AS size FROM {tiles} WHERE payload IS NOT NULL GROUP BY 1"
_SEGMENTS = f"SELECT segment, COUNT(*) AS tiles, CAST(SUM(size) AS BIGINT) AS bytes FROM (SELECT size, CAST(FLOOR((SUM(size) OVER (ORDER BY tile_hash) - size) / 1048576e0) AS BIGINT) AS segment FROM ({_TILES}) x) y GROUP BY segment"


def _le(number, size):
    """SQL of a number's bytes in hex, the lowest first."""
    return f"array_to_string(list_reverse(regexp_extract_all(lpad(lower(printf('%x', CAST({number} AS BIGINT))), {2 * size}, '0'), '..')), '')"


def _headers(t):
    segments = store.segments(store.deduplicated(t.tiles.where("payload is not null")), 1 << 20)
    fields = {"magic": F.lit(_MAGIC), "version_major": F.lit(1), "index": F.col("segment"), "segment_type": F.lit(1), "tile_count": F.col("tiles"), "payload_offset": F.lit(codecs.BLOCK), "payload_size": F.col("bytes")}
    return segments.select("segment", codecs.encoded(codecs.SEGMENT, fields, codecs.BLOCK).alias("header"))


@query(f"SELECT segment, lower('{_MAGIC.hex()}') || {_le(1, 4)} || {_le(0, 4)} || {_le('segment', 4)} || {_le(1, 4)} || {_le(0, 8)} || {_le('tiles', 4)} || {_le(4096, 8)} || {_le('bytes', 8)} || repeat('00', 4044) AS header FROM ({_SEGMENTS}) s")
def segment_headers(t):
    """The 4096-byte header of each segment."""
    return _headers(t).select("segment", F.lower(F.hex("header")).alias("header"))


@query(f"SELECT segment, tiles, bytes, 4096 + bytes AS file_bytes FROM ({_SEGMENTS}) s")
def segment_scan(t):
    """Headers read back: what each says of its segment, and the bytes that a file of it has."""
    read = _headers(t).select(codecs.checked(codecs.SEGMENT, F.col("header"), _MAGIC).alias("h"))
    return read.select(F.col("h.index").alias("segment"), F.col("h.tile_count").alias("tiles"), F.col("h.payload_size").alias("bytes"), (F.col("h.payload_offset") + F.col("h.payload_size")).alias("file_bytes"))


@query(f"SELECT lower('{b'STORE001'.hex()}') || {_le(1, 4)} || {_le(0, 8)} || {_le(0, 8)} || {_le('segments', 4)} || {_le('tiles', 8)} || {_le('4096 * (segments + 1) + stored', 8)} || {_le(0, 8)} || repeat('00', 64) || {_le('written', 8)} || {_le('stored', 8)} || {_le(0, 4)} || repeat('00', 3956) AS superblock FROM (SELECT (SELECT COUNT(*) FROM ({_SEGMENTS}) s) AS segments, COUNT(*) AS tiles, CAST(SUM(size) AS BIGINT) AS stored, CAST(SUM(size * n) AS BIGINT) AS written FROM (SELECT sha256(payload) AS tile_hash, MIN(CAST(octet_length(encode(payload)) AS BIGINT)) AS size, COUNT(*) AS n FROM {{tiles}} WHERE payload IS NOT NULL GROUP BY 1) x) z")
def superblock(t):
    """The first block of a store of all tiles."""
    payloads = t.tiles.where("payload is not null")
    tiles = store.deduplicated(payloads)
    one = store.store_stats(payloads).crossJoin(store.segments(tiles, 1 << 20).agg(F.count("*").alias("segments")))
    fields = {"magic": F.lit(b"STORE001"), "version": F.lit(1), "segment_count": F.col("segments"), "tile_count": F.col("tiles"), "total_size": codecs.BLOCK * (F.col("segments") + 1) + F.col("stored_bytes"), "total_logical_bytes": F.col("written_bytes"), "total_stored_bytes": F.col("stored_bytes")}
    return one.select(F.lower(F.hex(codecs.encoded(codecs.SUPERBLOCK, fields, codecs.BLOCK))).alias("superblock"))


@query("SELECT cell_id, CAST(json_object('cell_id', cell_id, 'dtype', dtype_code, 'lifecycle', lifecycle, 'name', name, 'size', size) AS VARCHAR) AS line FROM {cells}")
def manifest_lines(t):
    """A manifest as one line of canonical JSON for each cell."""
    fields = F.struct("cell_id", F.col("dtype_code").alias("dtype"), "lifecycle", "name", "size")
    return t.cells.select("cell_id", codecs.canonical_json(F.to_json(fields)).alias("line"))


@query("SELECT cell_id, dtype_code AS dtype, lifecycle, size FROM {cells}")
def manifest_load(t):
    """Manifest lines read back as columns."""
    read = manifest_lines(t).select(F.from_json("line", "cell_id long, dtype int, lifecycle string, name string, size long").alias("m"))
    return read.select("m.cell_id", "m.dtype", "m.lifecycle", "m.size")


@query("SELECT event_id, CAST(json_object('event_id', event_id, 'level', CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warn' WHEN 'signup' THEN 'Info' WHEN 'click' THEN 'Debug' ELSE 'Trace' END, 'target', event_type, 'thread_id', user_id) AS VARCHAR) AS line FROM {events}")
def json_log_lines(t):
    """Log records as JSON lines."""
    level = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "purchase", "Warn").when(F.col("event_type") == "signup", "Info").when(F.col("event_type") == "click", "Debug").otherwise("Trace")
    return t.events.select("event_id", F.to_json(F.struct("event_id", level.alias("level"), F.col("event_type").alias("target"), F.col("user_id").alias("thread_id"))).alias("line"))


@query("SELECT doc_id, 'b3:' || sha256(text) AS text_form, TRUE AS parsed FROM {documents} WHERE text IS NOT NULL")
def hash_texts(t):
    """Hashes in prefixed text form, read back to their bytes."""
    shown = t.documents.where("text is not null").select("doc_id", codecs.hash_text(content_hash(F.col("text"))).alias("text_form"), content_hash(F.col("text")).alias("own"))
    return shown.select("doc_id", "text_form", (F.lower(F.hex(codecs.parse_hash(F.col("text_form")))) == F.col("own")).alias("parsed"))


@query("SELECT codec, COUNT(*) AS tiles, CAST(SUM(octet_length(encode(payload))) AS BIGINT) AS restored_bytes, CAST(0 AS BIGINT) AS damaged FROM {tiles} CROSS JOIN (VALUES ('none'), ('zstd')) c(codec) WHERE payload IS NOT NULL GROUP BY codec")
def tile_compression(t):
    """Payloads compressed and restored by each codec."""
    tiles = t.tiles.where("payload is not null").select(F.col("payload").cast("binary").alias("payload"), content_hash(F.col("payload")).alias("own"))
    back = lambda codec: codecs.decompressed(codecs.compressed(tiles, "payload", codec), "payload", codec).select(F.lit(codec).alias("codec"), F.octet_length("payload").alias("n"), (content_hash(F.col("payload")) != F.col("own")).alias("wrong"))
    return back("none").union(back("zstd")).groupBy("codec").agg(F.count("*").alias("tiles"), F.sum("n").cast("long").alias("restored_bytes"), F.count_if("wrong").alias("damaged"))


@query("SELECT r.rev, r.parent, ROUND(COALESCE(SUM(a.amount * b.amount), 0) / (MAX(x.norm) * MAX(y.norm)), 6) AS similarity FROM {revisions} r JOIN (SELECT rev, SQRT(SUM(amount * amount * 1e0)) AS norm FROM (SELECT rev, cell, MAX(amount) AS amount FROM {rev_cells} GROUP BY 1, 2) n GROUP BY rev) x ON x.rev = r.rev JOIN (SELECT rev, SQRT(SUM(amount * amount * 1e0)) AS norm FROM (SELECT rev, cell, MAX(amount) AS amount FROM {rev_cells} GROUP BY 1, 2) n GROUP BY rev) y ON y.rev = r.parent LEFT JOIN (SELECT rev, cell, MAX(amount) AS amount FROM {rev_cells} GROUP BY 1, 2) a ON a.rev = r.rev LEFT JOIN (SELECT rev, cell, MAX(amount) AS amount FROM {rev_cells} GROUP BY 1, 2) b ON b.rev = r.parent AND b.cell = a.cell GROUP BY r.rev, r.parent")
def sparse_similarity(t):
    """Cosine of sparse vectors (cell, amount) of a revision and its parent, over the cells that both have, with norms of their own."""
    vectors = t.rev_cells.groupBy("rev", "cell").agg(F.max("amount").alias("amount"))
    pairs = t.revisions.where("parent is not null").select("rev", "parent")
    return store.sparse_cosine(pairs, vectors).select("rev", "parent", F.round("similarity", 6).alias("similarity"))

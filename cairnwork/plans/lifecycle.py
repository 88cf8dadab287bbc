"""Queries on what happens to a store over time: updates, quarantine, locations, access policies, retrieval, registries, metrics, migrations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import catalogs, scalars
from ..operators import store, telemetry, updates
from .registry import query

_CELLS = "(SELECT seq, kind, frequency, confidence, UNNEST(CASE WHEN other IS NULL THEN [cell] ELSE [cell, other] END) AS each FROM {updates})"


@query(
    f"""WITH s AS (SELECT pattern, seq AS s0, frequency AS f0, compute AS c0 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pattern ORDER BY seq DESC) AS n FROM {{updates}} WHERE kind = 0) x WHERE n = 1),
    l AS (SELECT u.pattern, u.frequency, u.compute, ROW_NUMBER() OVER (PARTITION BY u.pattern ORDER BY u.seq DESC) AS back FROM {{updates}} u JOIN s ON s.pattern = u.pattern AND u.kind = 1 AND u.seq > s.s0),
    g AS (SELECT pattern, SUM(frequency) AS more, COUNT(*) AS n, SUM(compute * power(5e-1, back)) AS recent FROM l GROUP BY pattern)
    SELECT state, CAST(key AS BIGINT) AS key, CAST(n AS BIGINT) AS n, ROUND(value, 6) AS value FROM (
    SELECT 'pattern' AS state, s.pattern AS key, f0 + COALESCE(more, 0) AS n, c0 * power(5e-1, COALESCE(g.n, 0)) + COALESCE(recent, 0) AS value FROM s LEFT JOIN g ON g.pattern = s.pattern
    UNION ALL SELECT 'cell_refs', each, COUNT(*), NULL FROM {_CELLS} c WHERE kind = 2 GROUP BY each UNION ALL SELECT 'tile_refs', each, COUNT(*), NULL FROM {_CELLS} c WHERE kind = 3 GROUP BY each
    UNION ALL SELECT 'routing_hint', each, COUNT(*), SUM(frequency * confidence) FROM {_CELLS} c WHERE kind = 4 GROUP BY each
    UNION ALL SELECT 'cache_hint', each, CASE WHEN arg_max(frequency, seq) > 10 THEN 0 WHEN arg_max(frequency, seq) > 5 THEN 1 ELSE 2 END, NULL FROM {_CELLS} c WHERE kind = 5 GROUP BY each
    UNION ALL SELECT 'consolidation', cell, COUNT(*), arg_max(confidence, seq) FROM {{updates}} WHERE kind = 6 AND other IS NOT NULL GROUP BY cell
    UNION ALL SELECT 'replay_buffer', each, 1, NULL FROM {_CELLS} c WHERE kind = 7 GROUP BY each UNION ALL SELECT 'affected', each, 1, NULL FROM {_CELLS} c WHERE kind = 8 GROUP BY each) z"""
)
def update_log(t):
    """The state that a log of updates of all nine kinds leaves."""
    return updates.applied(t.updates).select("state", "key", "n", F.round("value", 6).alias("value"))


@query("SELECT key, sha256(payload || 'x') AS tile_hash, 'hash mismatch' AS reason FROM {tiles} WHERE payload IS NOT NULL AND length(payload) % 97 = 0")
def tile_quarantine(t):
    """Tiles whose bytes do not give their stated hash, with the reason."""
    damaged = F.when(F.length("payload") % 97 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload"))
    stated = t.tiles.where("payload is not null").withColumn("tile_hash", scalars.content_hash(damaged))
    return store.mismatched(stated).select("key", "tile_hash", "reason")


@query("SELECT DISTINCT sha256(payload) AS tile_hash FROM {tiles} WHERE payload IS NOT NULL AND sha256(payload) NOT IN (SELECT sha256(text) FROM {documents} WHERE text IS NOT NULL AND doc_id % 5 = 0 GROUP BY 1 HAVING COUNT_IF(doc_id % 10 = 0) = 0)")
def tile_readable(t):
    """Tiles that are not in quarantine: documents in fives were put there, those in tens released again."""
    known = store.with_ids(t.tiles.where("payload is not null")).select("tile_hash").distinct()
    put = store.with_ids(t.documents.where("text is not null and doc_id % 5 = 0").select("doc_id", F.col("text").alias("payload"))).select("tile_hash", "doc_id")
    log = put.select("tile_hash", F.lit(1).alias("seq"), F.lit(True).alias("held")).union(put.where("doc_id % 10 = 0").select("tile_hash", F.lit(2), F.lit(False)))
    held = log.groupBy("tile_hash").agg(F.max_by("held", "seq").alias("held")).where("held")
    return known.join(held, "tile_hash", "left_anti")


@query("SELECT l.doc_id FROM {labels} l WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = l.doc_id AND d.text IS NOT NULL AND octet_length(encode(d.text)) > 200)")
def registry_consistency(t):
    """Registered ids (labels) whose tile is missing or under 200 bytes."""
    readable = t.documents.where(F.octet_length("text") > 200).select("doc_id")
    return t.labels.select("doc_id").join(readable, "doc_id", "left_anti")


_PLACED = "SELECT tile_hash, size, CAST(FLOOR(before / 1048576e0) AS BIGINT) AS segment, before FROM (SELECT tile_hash, size, CAST(SUM(size) OVER (ORDER BY tile_hash) - size AS BIGINT) AS before FROM (SELECT sha256(payload) AS tile_hash, MIN(CAST(octet_length(encode(payload)) AS BIGINT)) AS size FROM {tiles} WHERE payload IS NOT NULL GROUP BY 1) x) y"


@query(f"SELECT p.tile_hash, p.segment, CAST(p.before - s.first AS BIGINT) AS byte_offset, CAST(p.size AS BIGINT) AS size, CAST(s.bytes AS BIGINT) AS segment_bytes FROM ({_PLACED}) p JOIN (SELECT segment, MIN(before) AS first, SUM(size) AS bytes FROM ({_PLACED}) q GROUP BY segment) s ON s.segment = p.segment")
def tile_locations(t):
    """Where each tile lies: its segment, its first byte there, and the bytes that the segment holds."""
    placed = store.running_bytes(store.deduplicated(t.tiles.where("payload is not null")), "tile_hash").withColumn("segment", F.floor(F.col("before") / (1 << 20)).cast("long"))
    held = placed.groupBy("segment").agg(F.min("before").alias("first"), F.sum("size").alias("segment_bytes"))
    return placed.join(held, "segment").select("tile_hash", "segment", (F.col("before") - F.col("first")).alias("byte_offset"), "size", "segment_bytes")


_TILED = "(SELECT cell, tile, amount FROM (SELECT l_partkey AS cell, l_suppkey AS tile, CAST(MAX(l_quantity) AS BIGINT) AS amount FROM {lineitem} GROUP BY 1, 2) x)"


@query(
    f"""SELECT 'FullCell' AS policy, cell, COUNT(*) AS tiles FROM {_TILED} t GROUP BY cell UNION ALL SELECT 'Range', cell, COUNT(*) FROM {_TILED} t WHERE tile BETWEEN 10 AND 50 GROUP BY cell
    UNION ALL SELECT 'TopK', cell, COUNT(*) FROM (SELECT cell, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY amount DESC, tile) AS n FROM {_TILED} t) y WHERE n <= 3 GROUP BY cell UNION ALL SELECT 'Predicate', cell, COUNT(*) FROM {_TILED} t WHERE amount > 25 GROUP BY cell"""
)
def access_policies(t):
    """How many of its tiles each cell gives under each policy."""
    tiled = t.lineitem.groupBy(F.col("l_partkey").alias("cell"), F.col("l_suppkey").alias("tile")).agg(F.max("l_quantity").cast("long").alias("amount"))
    policies = {"FullCell": store.FULL_CELL, "Range": store.in_range("tile", 10, 50), "TopK": store.top_k(3, ["cell"], [F.col("amount").desc(), F.col("tile")]), "Predicate": store.matching(F.col("amount") > 25)}
    counted = [policy(tiled).groupBy("cell").agg(F.count("*").alias("tiles")).select(F.lit(name).alias("policy"), "cell", "tiles") for name, policy in policies.items()]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


_COS = "list_sum(list_transform(range(1, 1 + len(q)), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))) / (SQRT(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * SQRT(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * x))))"
_NEAR = f"(SELECT id, lang, importance, age_hours, access_count, memory_type, {_COS} AS sim FROM {{memory}} m, (SELECT embedding AS q FROM {{embeddings}} WHERE vec_id = 0) z WHERE m.embedding IS NOT NULL)"


def _near(t):
    asked = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return t.memory.where("embedding is not null").crossJoin(F.broadcast(asked)).withColumn("sim", scalars.cosine(F.col("embedding"), F.col("q")))


@query(f"SELECT id, ROUND(sim, 6) AS sim FROM {_NEAR} n WHERE sim >= 5e-2 AND age_hours BETWEEN 24 AND 480 AND lang IN ('en', 'fr')")
def memory_retrieve_filtered(t):
    """Records above a score, within a range of time, of some domains."""
    return _near(t).where((F.col("sim") >= 0.05) & F.col("age_hours").between(24, 480) & F.col("lang").isin("en", "fr")).select("id", F.round("sim", 6).alias("sim"))


@query(f"SELECT id, ROUND(sim * importance * (1 + 2e-1 * EXP(-age_hours / 24)) * (1 + 1e-1 * LN(1 + access_count)) * CASE WHEN memory_type = 1 THEN 12e-1 ELSE 1e0 END, 6) AS score FROM (SELECT * FROM {_NEAR} n WHERE sim >= 2e-2 ORDER BY sim DESC, id LIMIT 20) o ORDER BY 2 DESC, id LIMIT 10")
def memory_retrieve_overfetch(t):
    """The 20 nearest above a threshold, scored again, the 10 best of them."""
    near = _near(t).where("sim >= 0.02").orderBy(F.col("sim").desc(), "id").limit(20)
    score = scalars.retrieval_score(F.col("sim"), F.col("importance"), F.col("age_hours"), F.col("access_count"), F.col("memory_type") == 1)
    return near.select("id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(10)


_CONVERSIONS = catalogs.values_sql(catalogs.CONVERSIONS, "source", "target", "allowed", "lossy")
_NAMES = catalogs.values_sql([(i + 1, n) for i, (n, _) in enumerate(catalogs.DTYPES)], "code", "name")


@query(f"SELECT c.cell_id, n.name AS source, v.target, COALESCE(v.allowed, FALSE) AS allowed, COALESCE(v.lossy, FALSE) AS lossy FROM {{cells}} c JOIN {_NAMES} n ON n.code = c.dtype_code LEFT JOIN {_CONVERSIONS} v ON v.source = n.name")
def dtype_conversions(t):
    """What each cell's type may be converted to; types without a rule may not."""
    names = F.broadcast(catalogs.dtypes(t.spark).select(F.col("code").alias("dtype_code"), F.col("name").alias("source")))
    rules = F.broadcast(catalogs.conversions(t.spark))
    return t.cells.join(names, "dtype_code").join(rules, "source", "left").select("cell_id", "source", "target", F.coalesce("allowed", F.lit(False)).alias("allowed"), F.coalesce("lossy", F.lit(False)).alias("lossy"))


@query("SELECT hash, latency_us * (1e3 / (500 + hash % 1000)) AS normalized FROM {routing}")
def normalized_latency(t):
    """Latency on hardware of a score, as the reference hardware (score 1000) would have it."""
    return t.routing.select("hash", scalars.normalized_latency(F.col("latency_us"), F.lit(1000.0), 500 + F.col("hash") % 1000).alias("normalized"))


@query("SELECT cell_id, CASE WHEN explores AND other IS NOT NULL THEN other ELSE best END AS chosen FROM (SELECT cell_id, MAX(CASE WHEN n = 1 THEN ordinal END) AS best, MIN(CASE WHEN n > 1 THEN ordinal END) AS other, cell_id * 7919 % 100 < 10 AS explores FROM (SELECT cell_id, o AS ordinal, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY (cell_id * 31 + o * 17) % 1000, o) AS n FROM {cells} CROSS JOIN (VALUES (0), (1), (2), (3)) v(o)) x GROUP BY cell_id) y")
def representation_explore(t):
    """The smallest representation, but for one cell in ten (by its number) the first of the others."""
    reps = t.cells.select("cell_id", F.explode(F.array(*map(F.lit, range(4)))).alias("ordinal")).withColumn("size", (F.col("cell_id") * 31 + F.col("ordinal") * 17) % 1000)
    best = reps.groupBy("cell_id").agg(F.min(F.struct("size", "ordinal"))["ordinal"].alias("best"))
    other = reps.join(best, "cell_id").where("ordinal <> best").groupBy("cell_id").agg(F.min("ordinal").alias("other"))
    explores = F.col("cell_id") * 7919 % 100 < 10
    return best.join(other, "cell_id", "left").select("cell_id", F.when(explores & F.col("other").isNotNull(), F.col("other")).otherwise(F.col("best")).alias("chosen"))


@query("SELECT cell, event_type AS policy, seq AS since FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY seq DESC) AS n FROM {access_log}) x WHERE n = 1 AND event_type <> 'error'")
def routing_registry(t):
    """A registry kept as a log: the last entry of each cell counts, an error removes it."""
    last = t.access_log.groupBy("cell").agg(F.max_by(F.struct("event_type", "seq"), "seq").alias("last"))
    return last.where("last.event_type <> 'error'").select("cell", F.col("last.event_type").alias("policy"), F.col("last.seq").alias("since"))


@query("SELECT cell, seq AS span_start, ends AS span_end FROM (SELECT cell, seq, event_type, MIN(CASE WHEN event_type = 'purchase' THEN seq END) OVER (PARTITION BY cell ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ends FROM {access_log}) x WHERE event_type = 'signup' AND ends IS NOT NULL")
def trace_spans(t):
    """Spans from a log of starts (signup) and ends (purchase): each start's next end in its trace."""
    ahead = W.partitionBy("cell").orderBy("seq").rowsBetween(1, W.unboundedFollowing)
    marked = t.access_log.where("event_type in ('signup', 'purchase')").withColumn("ends", F.min(F.when(F.col("event_type") == "purchase", F.col("seq"))).over(ahead))
    return marked.where("event_type = 'signup' and ends is not null").select("cell", F.col("seq").alias("span_start"), F.col("ends").alias("span_end"))


_SIDES = "(SELECT cell, MIN(rev) AS ra, MAX(rev) AS rb FROM {rev_cells} GROUP BY cell HAVING MIN(rev) <> MAX(rev))"
_CLASH = f"(SELECT c.cell, c.ra, c.rb, a.amount AS va, b.amount AS vb FROM {_SIDES} c JOIN (SELECT rev, cell, MAX(amount) AS amount FROM {{rev_cells}} GROUP BY 1, 2) a ON a.rev = c.ra AND a.cell = c.cell JOIN (SELECT rev, cell, MAX(amount) AS amount FROM {{rev_cells}} GROUP BY 1, 2) b ON b.rev = c.rb AND b.cell = c.cell WHERE a.amount <> b.amount)"


@query(f"SELECT cell, strategy, CASE strategy WHEN 'PreferA' THEN va WHEN 'PreferB' THEN vb WHEN 'PreferLatest' THEN vb WHEN 'MergeSemantics' THEN CASE WHEN ABS(va - vb) <= 10 THEN GREATEST(va, vb) END WHEN 'CreateNew' THEN va + vb END AS resolved, strategy = 'Manual' OR (strategy = 'MergeSemantics' AND ABS(va - vb) > 10) AS open FROM {_CLASH} x CROSS JOIN (VALUES ('Manual'), ('PreferA'), ('PreferB'), ('PreferLatest'), ('MergeSemantics'), ('CreateNew')) s(strategy)")
def conflict_strategies(t):
    """The first and last change of each cell under all six strategies; values near each other merge, others stay open."""
    per = t.rev_cells.groupBy("cell", "rev").agg(F.max("amount").alias("amount"))
    ends = per.groupBy("cell").agg(F.min(F.struct("rev", "amount")).alias("a"), F.max(F.struct("rev", "amount")).alias("b")).where("a.rev <> b.rev and a.amount <> b.amount")
    a, b = F.col("a.amount"), F.col("b.amount")
    near = F.abs(a - b) <= 10
    of = {"Manual": (F.lit(None).cast("long"), F.lit(True)), "PreferA": (a, F.lit(False)), "PreferB": (b, F.lit(False)), "PreferLatest": (F.when(F.col("a.rev") > F.col("b.rev"), a).otherwise(b), F.lit(False)), "MergeSemantics": (F.when(near, F.greatest(a, b)), ~near), "CreateNew": (a + b, F.lit(False))}
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("strategy"), value.alias("resolved"), still.alias("open")) for name, (value, still) in of.items()])).alias("r")
    return ends.select("cell", rows).select("cell", "r.*")


@query("SELECT id, access_count > 100 AS by_access, age_hours > 168 AND access_count > 10 AS by_time, importance > 8e-1 AS by_importance, alike > 1 AS by_similarity FROM (SELECT *, COUNT(*) OVER (PARTITION BY key, memory_type, value) AS alike FROM {memory}) m WHERE access_count > 100 OR (age_hours > 168 AND access_count > 10) OR importance > 8e-1 OR alike > 1")
def consolidation_triggers(t):
    """All four rules: access, time, importance, and several records alike (same key, type and value)."""
    memory = t.memory.withColumn("h", F.sha2(F.to_json(F.struct("key", "memory_type", "value")), 256))
    alike = memory.groupBy("h").agg(F.count("*").alias("alike"))
    rules = {"by_access": F.col("access_count") > 100, "by_time": (F.col("age_hours") > 168) & (F.col("access_count") > 10), "by_importance": F.col("importance") > 0.8, "by_similarity": F.col("alike") > 1}
    return memory.join(alike, "h").select("id", *[r.alias(n) for n, r in rules.items()]).where(" or ".join(rules))


@query("SELECT cell, item, CAST(freed AS BIGINT) AS freed FROM (SELECT cell, item, size, SUM(size) OVER (PARTITION BY cell ORDER BY priority, last_use, item ROWS UNBOUNDED PRECEDING) AS freed FROM (SELECT cell, event_type AS item, MAX(seq) AS last_use, COUNT(*) * 100 AS size, MIN(CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 1 ELSE 2 END) AS priority FROM {access_log} GROUP BY 1, 2) e) x WHERE freed - size < 500")
def cache_priority_eviction(t):
    """Entries that go until 500 bytes are free: the lowest priority first, of one priority those used longest ago."""
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type").isin("view", "click"), 1).otherwise(2)
    entries = t.access_log.groupBy("cell", F.col("event_type").alias("item")).agg(F.max("seq").alias("last_use"), (F.count("*") * 100).alias("size"), F.min(rank).alias("priority"))
    so_far = W.partitionBy("cell").orderBy("priority", "last_use", "item").rowsBetween(W.unboundedPreceding, W.currentRow)
    return entries.withColumn("freed", F.sum("size").over(so_far)).where(F.col("freed") - F.col("size") < 500).select("cell", "item", "freed")


_V1 = "(SELECT cell_id, dtype_code, size, lifecycle FROM {cells})"


@query(f"SELECT cell_id, n.name AS dtype, CAST(size AS BIGINT) AS uncompressed_size, CAST(0 AS INT) AS compression, 1 AS major, 0 AS minor, lifecycle <> 'Tombstone' AS kept, '2' AS store_version FROM {_V1} v JOIN {_NAMES} n ON n.code = v.dtype_code")
def store_migration(t):
    """A first-version manifest as one of the second: types by name, compression and versions filled in, tombstones marked."""
    names = F.broadcast(catalogs.dtypes(t.spark).select(F.col("code").alias("dtype_code"), F.col("name").alias("dtype")))
    return store.migrated(t.cells.select("cell_id", "dtype_code", "size", "lifecycle").join(names, "dtype_code"))


_SAMPLES = telemetry.SAMPLES_SQL


@query(f"SELECT metric, label, CAST(SUM(count) AS BIGINT) AS count, ROUND(SUM(value), 4) AS value FROM ({_SAMPLES}) s GROUP BY metric, label")
def metric_catalogue(t):
    """Counters, labelled counters, gauges and histogram sums of the whole catalogue, in one pass over the log."""
    return telemetry.catalogue(t.access_log).select("metric", "label", "count", F.round("value", 4).alias("value"))


@query(f"""SELECT metric, label, metric || CASE WHEN label = '' THEN '' ELSE '{{label="' || label || '"}}' END || ' ' || CAST(CAST(SUM(count) AS BIGINT) AS STRING) AS line FROM ({_SAMPLES}) s GROUP BY metric, label""")
def metric_lines(t):
    """The catalogue's counts as lines of text for a collector."""
    return telemetry.exported(telemetry.catalogue(t.access_log))

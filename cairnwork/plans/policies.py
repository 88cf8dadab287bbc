"""Queries on policies: admission, limits, repair, conflict resolution, adaptation, and names taken apart."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.graph import on_cycles
from .registry import query

_PATHS = "(SELECT p_partkey, 'model.layers.' || CAST(p_partkey % 48 AS STRING) || '.moe.experts.' || CAST(p_partkey % 8 AS STRING) || '.w1' AS name FROM {part})"


def _paths(t):
    name = F.concat(F.lit("model.layers."), (F.col("p_partkey") % 48).cast("string"), F.lit(".moe.experts."), (F.col("p_partkey") % 8).cast("string"), F.lit(".w1"))
    return t.part.select("p_partkey", name.alias("name"))


@query(f"SELECT p_partkey, CAST(regexp_extract(name, 'layers\\.(\\d+)', 1) AS INT) AS layer, CAST(regexp_extract(name, 'experts\\.(\\d+)', 1) AS INT) AS expert FROM {_PATHS} x")
def name_metadata(t):
    return _paths(t).select("p_partkey", *[F.regexp_extract("name", rf"{word}s\.(\d+)", 1).cast("int").alias(word) for word in ("layer", "expert")])


@query("SELECT p_partkey, part, CAST(p_size * 64 AS BIGINT) AS n_rows, CAST(p_size * 64 * nth AS BIGINT) AS first_row FROM {part} CROSS JOIN (VALUES ('q', 0), ('k', 1), ('v', 2)) v(part, nth)")
def fused_qkv_split(t):
    parts = F.posexplode(F.array(F.lit("q"), F.lit("k"), F.lit("v"))).alias("at", "part")
    return t.part.select("p_partkey", "p_size", parts).select("p_partkey", "part", (F.col("p_size") * 64).cast("long").alias("n_rows"), (F.col("p_size") * 64 * F.col("at")).cast("long").alias("first_row"))


@query("SELECT url, CASE WHEN lower(url) LIKE '%/1%' THEN 'include' ELSE 'all' END AS rule FROM {pages} WHERE regexp_matches(url, '/(en|fr)/') AND NOT regexp_matches(url, '#')")
def import_filter(t):
    return t.pages.where(F.col("url").rlike("/(en|fr)/") & ~F.col("url").rlike("#")).select("url", F.when(F.lower("url").contains("/1"), "include").otherwise("all").alias("rule"))


@query("SELECT cell_id, CASE WHEN size > 150000 THEN 'Allocation' WHEN size > stored_size * 100 THEN 'Ratio' ELSE 'Ok' END AS verdict FROM {cells}")
def resource_limits(t):
    return t.cells.select("cell_id", F.when(F.col("size") > 150000, "Allocation").when(F.col("size") > F.col("stored_size") * 100, "Ratio").otherwise("Ok").alias("verdict"))


@query("SELECT cell_id, CAST(major AS STRING) || '.' || CAST(minor AS STRING) || '.' || CAST(cell_id % 4 AS STRING) AS version FROM {cells}")
def version_text(t):
    return t.cells.select("cell_id", scalars.version_text(F.col("major"), F.col("minor"), F.col("cell_id") % 4).alias("version"))


@query("SELECT hash, (successes + 1) / (selections + 2) * (1 / (1 + age_hours)) > size / 1e6 * latency_us / 1e5 AS admitted FROM {routing}")
def cache_admission(t):
    reuse, priority = (F.col("successes") + 1) / (F.col("selections") + 2), 1 / (1 + F.col("age_hours"))
    return t.routing.select("hash", (reuse * priority > F.col("size") / 1e6 * F.col("latency_us") / 1e5).alias("admitted"))


@query("SELECT cell, CASE WHEN rate > 95e-2 THEN GREATEST(0, depth - 1) WHEN rate < 7e-1 THEN LEAST(8, depth + 1) WHEN cell % 10 = 0 THEN GREATEST(0, depth - 1) ELSE depth END AS depth FROM (SELECT cell, AVG(success) AS rate, CAST(COUNT(*) % 9 AS INT) AS depth FROM {access_log} GROUP BY cell) x")
def prefetch_depth(t):
    stats = t.access_log.groupBy("cell").agg(F.avg("success").alias("rate"), (F.count("*") % 9).cast("int").alias("d"))
    down, up = F.greatest(F.lit(0), F.col("d") - 1), F.least(F.lit(8), F.col("d") + 1)
    return stats.select("cell", F.when(F.col("rate") > 0.95, down).when(F.col("rate") < 0.7, up).when(F.col("cell") % 10 == 0, down).otherwise(F.col("d")).alias("depth"))


@query("SELECT cell_id, CASE WHEN cell_id % 3 = 0 THEN 'Replica' WHEN cell_id % 5 = 0 THEN 'Remote' WHEN cell_id % 7 = 0 THEN 'Reimport' WHEN dtype_code <> 1 THEN 'Representation' ELSE 'Manual' END AS source FROM {cells} WHERE cell_id % 2 = 0")
def repair_source(t):
    """For each damaged tile (even keys) the first source that has it."""
    lost = t.cells.where("cell_id % 2 = 0").select("cell_id", "dtype_code")
    for name, each in (("Replica", 3), ("Remote", 5), ("Reimport", 7)):
        lost = lost.join(t.cells.where(F.col("cell_id") % each == 0).select("cell_id", F.lit(name).alias(name)), "cell_id", "left")
    return lost.select("cell_id", F.coalesce("Replica", "Remote", "Reimport", F.when(F.col("dtype_code") != 1, "Representation"), F.lit("Manual")).alias("source"))


_BOTH = "(SELECT c.cell AS cell, a.rev AS rev_a, b.rev AS rev_b, a.amount AS value_a, b.amount AS value_b FROM (SELECT cell, MIN(rev) AS ra, MAX(rev) AS rb FROM {rev_cells} GROUP BY cell HAVING MIN(rev) <> MAX(rev)) c JOIN (SELECT rev, cell, MAX(amount) AS amount FROM {rev_cells} GROUP BY 1, 2) a ON a.cell = c.cell AND a.rev = c.ra JOIN (SELECT rev, cell, MAX(amount) AS amount FROM {rev_cells} GROUP BY 1, 2) b ON b.cell = c.cell AND b.rev = c.rb)"


@query(f"SELECT cell, value_a AS prefer_a, value_b AS prefer_b, CASE WHEN rev_a > rev_b THEN value_a ELSE value_b END AS prefer_latest FROM {_BOTH} x WHERE value_a <> value_b")
def conflict_resolution(t):
    """First and last change of each cell under three strategies."""
    per = t.rev_cells.groupBy("cell", "rev").agg(F.max("amount").alias("amount"))
    ends = per.groupBy("cell").agg(F.min(F.struct("rev", "amount")).alias("a"), F.max(F.struct("rev", "amount")).alias("b"))
    clash = ends.where("a.rev <> b.rev and a.amount <> b.amount")
    return clash.select("cell", F.col("a.amount").alias("prefer_a"), F.col("b.amount").alias("prefer_b"), F.when(F.col("a.rev") > F.col("b.rev"), F.col("a.amount")).otherwise(F.col("b.amount")).alias("prefer_latest"))


@query("SELECT memory_type, CAST(COUNT_IF(lifecycle = 'Active') AS BIGINT) AS active, CAST(COUNT_IF(lifecycle = 'Archived') AS BIGINT) AS archived, CAST(SUM(access_count) AS BIGINT) AS accesses FROM {memory} GROUP BY memory_type")
def memory_stats_pivot(t):
    kind = lambda k: F.count_if(F.col("lifecycle") == k)
    return t.memory.groupBy("memory_type").agg(kind("Active").alias("active"), kind("Archived").alias("archived"), F.sum("access_count").alias("accesses"))


@query("SELECT DISTINCT a.tile FROM {rev_cells} a JOIN {rev_cells} b ON b.tile = a.tile WHERE a.rev % 2 = 0 AND b.rev % 2 = 1")
def shared_tiles(t):
    """Tiles that two models share (even and odd revisions)."""
    return t.rev_cells.where("rev % 2 = 0").select("tile").intersect(t.rev_cells.where("rev % 2 = 1").select("tile"))


@query("SELECT id FROM (SELECT id FROM {memory} WHERE importance > 7e-1 UNION SELECT d.target FROM {memory} m JOIN {deps} d ON d.source = m.id WHERE m.importance > 7e-1 AND d.kind < 3) x WHERE id IN (SELECT id FROM {memory})")
def retrieve_with_associations(t):
    direct = t.memory.where("importance > 0.7").select("id")
    near = t.deps.where("kind < 3").join(direct, F.col("source") == F.col("id")).select(F.col("target").alias("id"))
    return direct.union(near).distinct().join(t.memory.select("id"), "id", "left_semi")


@query("SELECT cell, CAST(MIN(CASE WHEN event_type = 'view' THEN 0 WHEN event_type = 'click' THEN 1 WHEN event_type = 'signup' THEN 2 ELSE 3 END) AS INT) AS level FROM {access_log} GROUP BY cell")
def cache_get_any(t):
    level = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    return t.access_log.groupBy("cell").agg(F.min(level).alias("level"))


@query("SELECT hash, CASE WHEN access_count > 800 THEN 0 WHEN access_count < 100 THEN 3 ELSE 1 END AS level, access_count > 800 AS promoted, access_count < 100 AS demoted FROM {routing}")
def cache_promotion(t):
    up, down = F.col("access_count") > 800, F.col("access_count") < 100
    return t.routing.select("hash", F.when(up, 0).when(down, 3).otherwise(1).alias("level"), up.alias("promoted"), down.alias("demoted"))


@query("SELECT txn, CAST(COUNT_IF(record_type = 'Write') AS BIGINT) AS writes, BOOL_OR(record_type = 'Commit') AS replayed FROM {wal} GROUP BY txn")
def recovery_report(t):
    """Writes of committed transactions are replayed, others are not."""
    return t.wal.groupBy("txn").agg(F.count_if(F.col("record_type") == "Write").alias("writes"), F.bool_or(F.col("record_type") == "Commit").alias("replayed"))


@query("SELECT l_orderkey, CAST(COUNT_IF(l_returnflag <> 'R') AS BIGINT) AS success, CAST(COUNT_IF(l_returnflag = 'R') AS BIGINT) AS failed, CAST(SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS bytes FROM {lineitem} GROUP BY l_orderkey")
def prefetch_stats(t):
    good = F.col("l_returnflag") != "R"
    return t.lineitem.groupBy("l_orderkey").agg(F.count_if(good).alias("success"), F.count_if(~good).alias("failed"), F.sum(F.when(good, F.col("l_quantity").cast("long")).otherwise(0)).alias("bytes"))


@query("SELECT rev, CAST(COUNT_IF(p.p_partkey IS NULL OR p.p_partkey % 10 = 9) AS BIGINT) = 0 AS accessible FROM {rev_cells} r LEFT JOIN {part} p ON p.p_partkey = r.cell GROUP BY rev")
def replay_accessible(t):
    """Whether all cells of a replay entry are there (keys that end in 9 are not)."""
    known = t.part.where("p_partkey % 10 <> 9").select(F.col("p_partkey").alias("cell"), F.lit(True).alias("there"))
    return t.rev_cells.join(known, "cell", "left").groupBy("rev").agg((F.count_if(F.col("there").isNull()) == 0).alias("accessible"))


@query("SELECT COUNT(*) AS on_cycles FROM {deps} WHERE target >= source")
def acyclic_check(t):
    """Nodes that reach themselves: none, as every edge leads to a smaller number."""
    return on_cycles(t.deps).agg(F.count("*").alias("on_cycles"))


@query("SELECT child.event_id, parent.event_id AS parent_id, CAST(child.value + parent.value AS DOUBLE) AS total FROM {events} child JOIN {events} parent ON parent.event_id = child.event_id - 1 AND parent.user_id = child.user_id")
def span_parents(t):
    e = t.events.select("event_id", "user_id", "value")
    parent = e.select((F.col("event_id") + 1).alias("event_id"), F.col("event_id").alias("parent_id"), "user_id", F.col("value").alias("parent_value"))
    return e.join(parent, ["event_id", "user_id"]).select("event_id", "parent_id", (F.col("value") + F.col("parent_value")).alias("total"))


@query("SELECT event_type, CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warn' WHEN 'signup' THEN 'Info' WHEN 'click' THEN 'Debug' ELSE 'Trace' END AS level, COUNT(*) AS entries FROM {events} GROUP BY 1, 2")
def log_levels(t):
    level = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "purchase", "Warn").when(F.col("event_type") == "signup", "Info").when(F.col("event_type") == "click", "Debug").otherwise("Trace")
    return t.events.groupBy("event_type", level.alias("level")).agg(F.count("*").alias("entries"))


@query("SELECT cell_id, (CASE dtype_code WHEN 1 THEN 1e0 WHEN 2 THEN 9e-1 WHEN 3 THEN 95e-2 ELSE 5e-1 END) * (1 - stored_size / (size * 2e0)) AS score, dtype_code IN (1, 3) AS strict_ok, dtype_code IN (2, 3, 4, 5) AS balanced_ok FROM {cells}")
def representation_policy(t):
    accuracy = F.when(F.col("dtype_code") == 1, 1.0).when(F.col("dtype_code") == 2, 0.9).when(F.col("dtype_code") == 3, 0.95).otherwise(0.5)
    return t.cells.select("cell_id", (accuracy * (1 - F.col("stored_size") / (F.col("size") * 2.0))).alias("score"), F.col("dtype_code").isin(1, 3).alias("strict_ok"), F.col("dtype_code").isin(2, 3, 4, 5).alias("balanced_ok"))


@query("SELECT shard, sha256(string_agg(tile_hash, '' ORDER BY tile_hash)) AS manifest, COUNT(*) AS tiles FROM (SELECT DISTINCT substring(sha256(payload), 1, 3) AS shard, sha256(payload) AS tile_hash FROM {tiles} WHERE payload IS NOT NULL) x GROUP BY shard")
def manifest_hash(t):
    """The manifest of each of 4096 shards of the store; the store's manifest lists theirs."""
    hashes = t.tiles.where("payload is not null").select(scalars.content_hash(F.col("payload")).alias("tile_hash")).distinct()
    shards = hashes.groupBy(F.substring("tile_hash", 1, 3).alias("shard"))
    return shards.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("tile_hash")), ""), 256).alias("manifest"), F.count("*").alias("tiles"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY sha256(CAST(l_partkey AS STRING) || '|' || CAST(l_suppkey AS STRING)), l_linenumber) AS n FROM {lineitem}) x WHERE n = 1")
def seeded_shuffle(t):
    """The first of each level in a shuffle that a hash decides, so that reruns agree."""
    turn = scalars.content_hash(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))
    first = F.row_number().over(W.partitionBy("l_orderkey").orderBy(turn, "l_linenumber"))
    return t.lineitem.withColumn("n", first).where("n = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

"""Queries on the dependency graph, caches and prefetching."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cache, graph
from .registry import query

_CLOSURE = "WITH RECURSIVE walk AS (SELECT source AS node, target AS reached, 1 AS depth FROM {deps} UNION SELECT w.node, d.target, w.depth + 1 FROM walk w JOIN {deps} d ON d.source = w.reached)"


@query(f"{_CLOSURE} SELECT node, COUNT(DISTINCT reached) AS reached, CAST(MAX(least) AS BIGINT) AS farthest FROM (SELECT node, reached, MIN(depth) AS least FROM walk GROUP BY 1, 2) x GROUP BY node")
def dep_closure(t):
    paths = graph.closure(t.deps)
    return paths.groupBy("node").agg(F.count("*").alias("reached"), F.max("depth").cast("long").alias("farthest"))


@query(f"{_CLOSURE} SELECT node, CAST(MAX(depth) AS INT) AS level FROM walk GROUP BY node UNION ALL SELECT DISTINCT target, 0 FROM {{deps}} WHERE target NOT IN (SELECT source FROM {{deps}})")
def dep_levels(t):
    return graph.levels(t.deps)


@query(f"{_CLOSURE} SELECT level, COUNT(*) AS cells, CAST(SUM(size) AS BIGINT) AS bytes FROM (SELECT node, MAX(depth) AS level FROM walk GROUP BY node) x JOIN {{cells}} c ON c.cell_id = x.node GROUP BY level")
def exec_accounting(t):
    leveled = graph.levels(t.deps).where("level > 0").join(t.cells, F.col("node") == F.col("cell_id"))
    return leveled.groupBy("level").agg(F.count("*").alias("cells"), F.sum("size").alias("bytes"))


_PLAN = """WITH RECURSIVE usable AS (SELECT source, target, MIN(kind) AS kind FROM {deps} WHERE kind < 4 AND target % 10 <> 9 GROUP BY 1, 2),
    walk AS (SELECT p_partkey AS target, p_partkey AS node, 0 AS depth, 0 AS priority FROM {part} WHERE p_partkey % 10 <> 9 UNION SELECT w.target, u.target, w.depth + 1, u.kind FROM walk w JOIN usable u ON u.source = w.node),
    firsts AS (SELECT target, node, MIN(depth) AS depth FROM walk GROUP BY 1, 2), plan AS (SELECT w.target, w.node, w.depth, MIN(w.priority) AS priority FROM walk w JOIN firsts f ON f.target = w.target AND f.node = w.node AND f.depth = w.depth GROUP BY 1, 2, 3)"""


def _plan(t, cap=None):
    targets = t.part.select(F.col("p_partkey").alias("target"))
    cached = t.part.where("p_partkey % 10 = 9").select(F.col("p_partkey").alias("node"))
    return graph.prefetch_plan(targets, t.deps, t.cells.select(F.col("cell_id").alias("node"), "size"), cached, cap)


@query(f"{_PLAN} SELECT target, COUNT(*) AS requests, CAST(SUM(size) AS BIGINT) AS bytes, CAST(COUNT(*) * 1000 + FLOOR(SUM(size) / 1048576e0) * 100 AS BIGINT) AS latency_us FROM plan p JOIN {{cells}} c ON c.cell_id = p.node GROUP BY target")
def prefetch_plan(t):
    """A plan for every cell; those whose key ends in 9 are cached."""
    return _plan(t).groupBy("target").agg(F.count("*").alias("requests"), F.sum("size").alias("bytes"), (F.count("*") * 1000 + F.floor(F.sum("size") / 1048576) * 100).cast("long").alias("latency_us"))


@query(f"{_PLAN} SELECT target, node, CAST(priority AS INT) AS priority, CAST(running AS BIGINT) AS running FROM (SELECT p.*, SUM(size) OVER (PARTITION BY target ORDER BY depth, priority, node ROWS UNBOUNDED PRECEDING) AS running FROM plan p JOIN {{cells}} c ON c.cell_id = p.node) x WHERE running <= 1000000")
def prefetch_byte_cap(t):
    return _plan(t, 1_000_000).select("target", "node", "priority", "running")


@query("SELECT l_orderkey, CAST(k AS INT) AS place, l_partkey AS expert FROM (SELECT l_orderkey, l_partkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS k FROM {lineitem}) x WHERE k < 2 AND l_partkey % 10 <> 9")
def moe_expert_prefetch(t):
    """The first two experts of each request, without those cached."""
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1
    ranked = t.lineitem.select("l_orderkey", place.alias("place"), F.col("l_partkey").alias("expert")).where("place < 2")
    cached = t.part.where("p_partkey % 10 = 9").select(F.col("p_partkey").alias("expert"))
    return ranked.join(cached, "expert", "left_anti").select("l_orderkey", "place", "expert")


@query("SELECT COUNT(*) AS requests, COUNT(DISTINCT l_partkey) AS experts, ROUND(COUNT(DISTINCT l_partkey) / (COUNT(*) * 1e0), 6) AS dedup_ratio FROM {lineitem}")
def moe_dedup_ratio(t):
    return t.lineitem.agg(F.count("*").alias("requests"), F.count_distinct("l_partkey").alias("experts"), F.round(F.count_distinct("l_partkey") / F.count("*"), 6).alias("dedup_ratio"))


@query("WITH RECURSIVE walk AS (SELECT 1 AS depth, conv_id AS conv, turn AS node FROM (SELECT DISTINCT conv_id, turn FROM {conversations}) c WHERE turn = 0 UNION SELECT w.depth + 1, w.conv, c.turn FROM walk w JOIN {conversations} c ON c.conv_id = w.conv AND c.turn = w.node + 1 WHERE w.depth < 4) SELECT conv, COUNT(DISTINCT node) AS reached, CAST(MAX(depth) AS BIGINT) AS depth FROM walk GROUP BY conv")
def association_traversal(t):
    """From each conversation's first turn along the turns, three steps at most."""
    turns = t.conversations.select("conv_id", "turn").distinct()
    front = turns.where("turn = 0").withColumn("depth", F.lit(1))
    out = front
    for depth in range(2, 5):
        front = turns.join(front.select("conv_id", (F.col("turn") + 1).alias("turn")), ["conv_id", "turn"]).withColumn("depth", F.lit(depth))
        out = out.union(front)
    return out.groupBy(F.col("conv_id").alias("conv")).agg(F.count_distinct("turn").alias("reached"), F.max("depth").cast("long").alias("depth"))


@query("SELECT node, COUNT(*) AS neighbours FROM (SELECT source AS node, target AS other FROM {deps} UNION SELECT target, source FROM {deps}) x GROUP BY node")
def association_neighbors(t):
    both = t.deps.select(F.col("source").alias("node"), F.col("target").alias("other")).union(t.deps.select("target", "source")).distinct()
    return both.groupBy("node").agg(F.count("*").alias("neighbours"))


@query("SELECT level, COUNT(*) AS entries, CAST(SUM(uses) AS BIGINT) AS uses, ROUND(SUM(uses) / (SELECT COUNT(*) * 1e0 FROM {access_log}), 6) AS share FROM (SELECT cell, COUNT(*) AS uses, CASE WHEN COUNT(*) > 10 THEN 0 WHEN COUNT(*) > 5 THEN 1 ELSE 2 END AS level FROM {access_log} GROUP BY cell) x GROUP BY level")
def cache_level_stats(t):
    return cache.level_stats(t.access_log)


@query(
    """SELECT seq, cell, (SELECT COUNT(DISTINCT b.event_type) FROM {access_log} b WHERE b.cell = a.cell AND b.seq > a.before AND b.seq < a.seq) AS distance
    FROM (SELECT seq, cell, event_type, LAG(seq) OVER (PARTITION BY cell, event_type ORDER BY seq) AS before FROM {access_log}) a WHERE before IS NOT NULL"""
)
def cache_reuse_distance(t):
    return cache.reuse_distance(t.access_log.select("seq", "cell", F.col("event_type").alias("item")))


@query("SELECT cell, item, CAST(freed AS BIGINT) AS freed FROM (SELECT cell, item, SUM(uses * 100) OVER (PARTITION BY cell ORDER BY last_use, item ROWS UNBOUNDED PRECEDING) AS freed, uses * 100 AS size FROM (SELECT cell, event_type AS item, MAX(seq) AS last_use, COUNT(*) AS uses FROM {access_log} GROUP BY 1, 2)) x WHERE freed - size < 500")
def cache_eviction_plan(t):
    entries = t.access_log.groupBy("cell", F.col("event_type").alias("item")).agg(F.max("seq").alias("last_use"), (F.count("*") * 100).alias("size"))
    return cache.eviction_plan(entries, 500)


@query()
def cache_lru_replay(t):
    return cache.lru_replay(t.access_log.select("seq", "cell", F.col("event_type").alias("item"), F.lit(100).cast("long").alias("size")), 300)


@query("SELECT txn FROM (SELECT DISTINCT txn FROM {wal} WHERE record_type = 'Begin') x WHERE txn NOT IN (SELECT txn FROM {wal} WHERE record_type = 'Commit')")
def wal_uncommitted(t):
    wal = t.wal
    return wal.where("record_type = 'Begin'").select("txn").distinct().join(wal.where("record_type = 'Commit'").select("txn"), "txn", "left_anti")


@query("SELECT txn, CASE record_type WHEN 'Begin' THEN 'RollbackCommit' WHEN 'Stage' THEN 'CleanupStaging' WHEN 'Rename' THEN 'CompleteSuperblock' WHEN 'Commit' THEN 'None' ELSE 'MarkComplete' END AS action FROM (SELECT txn, record_type, ROW_NUMBER() OVER (PARTITION BY txn ORDER BY seq DESC) AS n FROM {wal}) x WHERE n = 1")
def wal_last_action(t):
    last = t.wal.groupBy("txn").agg(F.max_by("record_type", "seq").alias("last"))
    action = F.when(F.col("last") == "Begin", "RollbackCommit").when(F.col("last") == "Stage", "CleanupStaging").when(F.col("last") == "Rename", "CompleteSuperblock").when(F.col("last") == "Commit", "None").otherwise("MarkComplete")
    return last.select("txn", action.alias("action"))


@query("SELECT record_type, COUNT(*) AS records, COUNT(DISTINCT txn) AS txns, MAX(seq) AS last_seq FROM {wal} GROUP BY record_type")
def wal_replay_counts(t):
    return t.wal.groupBy("record_type").agg(F.count("*").alias("records"), F.count_distinct("txn").alias("txns"), F.max("seq").alias("last_seq"))


@query("SELECT MAX(seq) AS keep_after FROM {wal} WHERE record_type = 'Commit'")
def wal_truncation(t):
    return t.wal.where("record_type = 'Commit'").agg(F.max("seq").alias("keep_after"))

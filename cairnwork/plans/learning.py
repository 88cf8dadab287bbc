"""Queries on use patterns and what is learnt from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import cache_tier
from .registry import query

_SEQ = "SELECT seq_id, string_agg(cell, '->' ORDER BY pos) AS pattern, COUNT(*) AS steps FROM {sequences} GROUP BY seq_id"


def _sequences(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "cell"))), lambda s: s["cell"])
    return t.sequences.groupBy("seq_id").agg(F.array_join(ordered, "->").alias("pattern"), F.count("*").alias("steps"))


@query(f"SELECT sha256(pattern) AS pattern_id, pattern, COUNT(*) AS frequency FROM ({_SEQ}) x GROUP BY pattern HAVING COUNT(*) >= 2")
def pattern_discovery(t):
    return _sequences(t).groupBy("pattern").agg(F.count("*").alias("frequency")).where("frequency >= 2").select(F.sha2("pattern", 256).alias("pattern_id"), "pattern", "frequency")


@query("SELECT pattern, COUNT(*) AS frequency FROM (SELECT conv_id, string_agg(role, '->' ORDER BY turn, role) AS pattern FROM {conversations} GROUP BY conv_id) x GROUP BY pattern HAVING COUNT(*) >= 2")
def conversation_patterns(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    chains = t.conversations.groupBy("conv_id").agg(F.array_join(ordered, "->").alias("pattern"))
    return chains.groupBy("pattern").agg(F.count("*").alias("frequency")).where("frequency >= 2")


@query(f"SELECT pattern, CAST(SUM(steps) AS BIGINT) AS frequency, ROUND(AVG(steps), 6) AS mean_steps FROM ({_SEQ}) x GROUP BY pattern")
def pattern_update_fold(t):
    return _sequences(t).groupBy("pattern").agg(F.sum("steps").alias("frequency"), F.round(F.avg("steps"), 6).alias("mean_steps"))


@query("SELECT cell, ROUND(SUM(n * confidence), 6) AS priority FROM (SELECT event_type AS cell, user_id, COUNT(*) AS n, AVG(success) AS confidence FROM (SELECT cell AS user_id, event_type, success FROM {access_log}) a GROUP BY 1, 2) x GROUP BY cell")
def routing_hints(t):
    each = t.access_log.groupBy(F.col("event_type").alias("kind"), "cell").agg(F.count("*").alias("n"), F.avg("success").alias("confidence"))
    return each.groupBy(F.col("kind").alias("cell")).agg(F.round(F.sum(F.col("n") * F.col("confidence")), 6).alias("priority"))


@query("SELECT cell, COUNT(*) AS frequency, CASE WHEN COUNT(*) > 10 THEN 0 WHEN COUNT(*) > 5 THEN 1 ELSE 2 END AS tier FROM {access_log} GROUP BY cell")
def cache_hints(t):
    return t.access_log.groupBy("cell").agg(F.count("*").alias("frequency")).withColumn("tier", cache_tier(F.col("frequency")))


@query("SELECT 'cell' AS kind, cell AS id, COUNT(*) AS refs FROM {rev_cells} GROUP BY cell UNION ALL SELECT 'tile', tile, COUNT(*) FROM {rev_cells} GROUP BY tile")
def ref_counts(t):
    pairs = F.explode(F.array(F.struct(F.lit("cell").alias("kind"), F.col("cell").alias("id")), F.struct(F.lit("tile").alias("kind"), F.col("tile").alias("id")))).alias("p")
    return t.rev_cells.select(pairs).groupBy("p.kind", "p.id").agg(F.count("*").alias("refs"))


@query("SELECT rev, COUNT(DISTINCT cell) AS cells, COUNT(DISTINCT tile) AS tiles FROM {rev_cells} GROUP BY rev")
def affected_cells(t):
    return t.rev_cells.groupBy("rev").agg(F.count_distinct("cell").alias("cells"), F.count_distinct("tile").alias("tiles"))


@query("SELECT rev, CAST(COUNT_IF(line % 3 = 0) AS BIGINT) AS created, CAST(COUNT_IF(line % 3 = 1) AS BIGINT) AS refined, CAST(COUNT_IF(line % 3 = 2) AS BIGINT) AS replaced, ROUND(COUNT(*) / (SELECT COUNT(*) * 1e0 FROM {part}), 9) AS ratio FROM {rev_cells} GROUP BY rev")
def affected_accounting(t):
    kind = lambda k: F.count_if(F.col("line") % 3 == k)
    total = t.part.agg(F.count("*").alias("total"))
    counted = t.rev_cells.groupBy("rev").agg(kind(0).alias("created"), kind(1).alias("refined"), kind(2).alias("replaced"), F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(total)).select("rev", "created", "refined", "replaced", F.round(F.col("n") / F.col("total"), 9).alias("ratio"))


@query("SELECT rev, COUNT(*) AS sources FROM {rev_cells} GROUP BY rev HAVING COUNT(*) >= 2")
def consolidation_records(t):
    return t.rev_cells.groupBy("rev").agg(F.count("*").alias("sources")).where("sources >= 2")


@query("SELECT CASE WHEN value < 50 THEN 'Easy' WHEN value < 200 THEN 'Medium' ELSE 'Hard' END AS difficulty, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean_value FROM {events} WHERE value IS NOT NULL GROUP BY 1")
def difficulty_buckets(t):
    bucket = F.when(F.col("value") < 50, "Easy").when(F.col("value") < 200, "Medium").otherwise("Hard")
    return t.events.where("value is not null").groupBy(bucket.alias("difficulty")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))

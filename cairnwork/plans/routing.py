"""Queries on routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import routing as ops
from .registry import query

_CONF = "CASE WHEN selections = 0 THEN 5e-1 ELSE successes / selections END"


@query(f"SELECT hash, ROUND(5e-1 * (1 / (1 + size / 1e6)) + 3e-1 * {_CONF} + 2e-1 * (1 / (1 + age_hours)), 6) AS score FROM {{routing}} ORDER BY 2 DESC, 1 LIMIT 10")
def routing_select_topk(t):
    return ops.select_topk(t.routing, scalars.size_similarity(F.col("size")), 10)


@query(
    f"""SELECT hash, ROUND(5e-1 * CASE WHEN nb = 0 THEN 0e0 ELSE d / (SQRT(nb) * SQRT(nq)) END + 3e-1 * {_CONF} + 2e-1 * (1 / (1 + age_hours)), 6) AS score FROM (SELECT r.*, list_sum(list_transform(range(1, 33), lambda i: v[i] * CAST(q[i] AS DOUBLE))) AS d, list_sum(list_transform(v, lambda x: x * x)) AS nb,
    list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS nq FROM (SELECT *, list_transform(range(0, 32), lambda i: CAST(('0x' || substring(sha256(CAST(hash AS STRING)), CAST(2 * i + 1 AS BIGINT), 2)) AS INT) / 255e0) AS v FROM {{routing}}) r, (SELECT embedding AS q FROM {{embeddings}} WHERE vec_id = 0) e) x ORDER BY 2 DESC, 1 LIMIT 10"""
)
def routing_select_hash_fallback(t):
    """Where a cell has no vector of the query's length, its hash's bytes stand for it; the query's norm takes all its places."""
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    v = scalars.hash_vector(scalars.content_hash(F.col("hash").cast("string")), F.size("q"))
    both = t.routing.crossJoin(F.broadcast(q)).withColumn("v", v)
    similarity = F.when(scalars.norm(F.col("v")) == 0, 0.0).otherwise(scalars.dot(F.col("v"), F.slice("q", 1, F.size("v"))) / (scalars.norm(F.col("v")) * scalars.norm(F.col("q"))))
    return ops.select_topk(both, similarity, 10)


def _route(policy: str, keywords: str, sql: str) -> None:
    name = "route_" + {"Local": "local", "Remote": "remote", "Auto": "auto", "LoadBalanced": "load_balanced", "LowestLatency": "lowest_latency"}[policy] + ("" if "zzz" not in keywords else "_fallback")
    query(sql, name)(lambda t: ops.route(t.routing, policy, keywords).select("hash"))


_KW = "(cell_type LIKE '%brass%' OR cell_type LIKE '%steel%')"
_TEN = "SELECT * FROM {routing} ORDER BY <c>, hash LIMIT 10"
_or_all = lambda base, where: f"SELECT hash FROM ({base}) a WHERE {where} OR NOT EXISTS (SELECT 1 FROM ({base}) b WHERE {where})"
_route("Local", "BRASS steel", _or_all("SELECT * FROM {routing} WHERE is_local", _KW))
_route("Remote", "BRASS steel", _or_all("SELECT * FROM {routing} WHERE NOT is_local", _KW))
_route("Auto", "BRASS steel", f"SELECT hash FROM {{routing}} WHERE ({_KW} OR NOT EXISTS (SELECT 1 FROM {{routing}} WHERE {_KW})) AND is_local = (SELECT BOOL_OR(is_local) FROM {{routing}} WHERE ({_KW} OR NOT EXISTS (SELECT 1 FROM {{routing}} WHERE {_KW})))")
_route("LoadBalanced", "BRASS steel", _or_all(_TEN.replace("<c>", "access_count"), _KW))
_route("LowestLatency", "BRASS steel", _or_all(_TEN.replace("<c>", "latency_us"), _KW))
_route("Local", "zzz", "SELECT hash FROM {routing} WHERE is_local")


@query("SELECT COUNT(*) AS queries, CAST(COUNT_IF(is_local) AS BIGINT) AS local_cells, CAST(COUNT_IF(NOT is_local) AS BIGINT) AS remote_cells, CAST(SUM(latency_us) AS BIGINT) AS latency FROM {routing}")
def routing_totals(t):
    return t.routing.agg(F.count("*").alias("queries"), F.count_if("is_local").alias("local_cells"), F.count_if(~F.col("is_local")).alias("remote_cells"), F.sum("latency_us").alias("latency"))


@query("SELECT cell, COUNT(*) AS selections, CAST(SUM(success) AS BIGINT) AS successes, ROUND(AVG(success), 6) AS success_rate, ROUND(AVG(value), 6) AS mean_value, MAX(seq) AS last_step FROM {access_log} GROUP BY cell")
def routing_cell_stats(t):
    return ops.usage(t.access_log)


@query("SELECT seq, cell, ROUND(AVG(value) OVER w, 9) AS mean_value, ROUND(AVG(success) OVER w, 9) AS success_rate FROM {access_log} WINDOW w AS (PARTITION BY cell ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def routing_running_avg(t):
    return ops.running(t.access_log)


@query("SELECT a, b, COUNT(*) AS times, CAST(SUM(success) AS BIGINT) AS successes FROM (SELECT event_type AS a, LEAD(event_type) OVER (PARTITION BY cell ORDER BY seq) AS b, success FROM {access_log}) x WHERE b IS NOT NULL GROUP BY 1, 2")
def routing_edge_stats(t):
    return ops.edges(t.access_log)


@query(f"SELECT hash, ROUND(({_CONF}) * (1 + 1e-1 * EXP(-age_hours / 10)) * CASE WHEN size <= 20000 THEN 1e0 WHEN size <= 40000 THEN 5e-1 ELSE 0e0 END, 6) AS score FROM {{routing}}")
def routing_budgeted_score(t):
    score = scalars.selection_score(F.lit(1.0), scalars.confidence(F.col("selections"), F.col("successes")), F.col("age_hours"), F.col("size"), F.lit(20000))
    return t.routing.select("hash", F.round(score, 6).alias("score"))

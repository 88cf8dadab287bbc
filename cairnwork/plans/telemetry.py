"""Queries on metrics, traces and benchmark samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import telemetry
from ..operators.graph import joinable
from ..shared import Written
from .registry import query

_EDGES = (10, 50, 100, 250, 500)


@query("SELECT event_type, COUNT(*) AS total, CAST(COUNT_IF(value > 100) AS BIGINT) AS above, ROUND(SUM(value), 4) AS value_sum FROM {events} GROUP BY event_type")
def metric_counters(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 100).alias("above"), F.round(F.sum("value"), 4).alias("value_sum"))


@query("SELECT event_type, le, CAST(COUNT_IF(value <= le) AS BIGINT) AS within FROM {events} CROSS JOIN (VALUES " + ", ".join(f"({e})" for e in _EDGES) + ") b(le) GROUP BY 1, 2")
def metric_histogram(t):
    """Cumulative buckets in one pass: one conditional count for each edge, then a row for each."""
    counted = t.events.groupBy("event_type").agg(*[F.count_if(F.col("value") <= e).alias(f"le{e}") for e in _EDGES])
    return counted.select("event_type", F.explode(F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"le{e}").alias("within")) for e in _EDGES])).alias("b")).select("event_type", "b.le", "b.within")


@query("SELECT event_type, 'events_total{type=\"' || event_type || '\"} ' || CAST(COUNT(*) AS STRING) AS line FROM {events} GROUP BY event_type")
def metric_export(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", F.concat(F.lit('events_total{type="'), "event_type", F.lit('"} '), F.col("n").cast("string")).alias("line"))


_KEPT = "SELECT l_returnflag AS flag, l_extendedprice AS x FROM {lineitem} JOIN (SELECT l_returnflag AS f, AVG(l_extendedprice) AS m, STDDEV_SAMP(l_extendedprice) AS s FROM {lineitem} GROUP BY 1) a ON f = l_returnflag WHERE ABS(l_extendedprice - m) <= 3 * s"


@query(f"SELECT flag, COUNT(*) AS n, ROUND(quantile_cont(x, 0.5), 4) AS p50, ROUND(quantile_cont(x, 0.95), 4) AS p95, ROUND(quantile_cont(x, 0.99), 4) AS p99, ROUND(AVG(x), 4) AS mean, ROUND(STDDEV_SAMP(x), 4) AS deviation FROM ({_KEPT}) k GROUP BY flag")
def latency_percentiles(t):
    """Exact percentiles without samples beyond three standard deviations."""
    samples = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("x"))
    spread = samples.groupBy("flag").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    spread = Written(t.spark)(spread)
    kept = samples.join(joinable(spread, spread.count()), "flag").where(F.abs(F.col("x") - F.col("m")) <= 3 * F.col("s"))
    picked = telemetry.percentiles(kept, "flag", "x", (0.5, 0.95, 0.99))
    told = kept.groupBy("flag").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("deviation"))
    p = lambda q: F.round(F.max(F.when(F.col("share") == q, F.col("value"))), 4)
    wide = picked.groupBy("flag").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))
    return told.join(wide, "flag").select("flag", "n", "p50", "p95", "p99", "mean", "deviation")


@query("SELECT brand, CASE WHEN now > base * 11e-1 THEN 'Block' WHEN now > base * 105e-2 THEN 'Warn' ELSE 'Pass' END AS verdict FROM (SELECT p_brand AS brand, AVG(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END) AS base, AVG(CASE WHEN p_partkey % 2 = 1 THEN p_retailprice END) AS now FROM {part} GROUP BY 1) x")
def regression_check(t):
    mean = lambda r: F.avg(F.when(F.col("p_partkey") % 2 == r, F.col("p_retailprice")))
    both = t.part.groupBy(F.col("p_brand").alias("brand")).agg(mean(0).alias("base"), mean(1).alias("now"))
    return both.select("brand", F.when(F.col("now") > F.col("base") * 1.1, "Block").when(F.col("now") > F.col("base") * 1.05, "Warn").otherwise("Pass").alias("verdict"))


@query("SELECT event_type, COUNT(DISTINCT user_id) AS labels, COUNT(DISTINCT user_id) > 50 AS too_many FROM {events} GROUP BY event_type")
def label_cardinality(t):
    n = F.count_distinct("user_id")
    return t.events.groupBy("event_type").agg(n.alias("labels"), (n > 50).alias("too_many"))


@query("SELECT event_id, CAST(date_diff('microsecond', before, ts) AS BIGINT) AS gap_us FROM (SELECT event_id, ts, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events}) x WHERE before IS NOT NULL")
def span_durations(t):
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", "ts", before.alias("before")).where("before is not null").select("event_id", F.timestamp_diff("MICROSECOND", "before", "ts").alias("gap_us"))


@query("SELECT ROUND(SUM(CASE WHEN p_partkey % 8 < 2 THEN p_size ELSE 0 END) / (SUM(p_size) * 1e0), 6) AS active_ratio FROM {part}")
def active_parameter_ratio(t):
    active = F.sum(F.when(F.col("p_partkey") % 8 < 2, F.col("p_size")).otherwise(0))
    return t.part.agg(F.round(active / F.sum("p_size"), 6).alias("active_ratio"))

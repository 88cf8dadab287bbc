"""Exact percentiles of many values without a task that holds a group, and a catalogue of metrics from one log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Written
from .graph import joinable

#: Ranges of values that a group is cut into.
RANGES = 1024


def percentiles(samples: DataFrame, group: str, value: str, shares: Sequence[float], ranges: int = RANGES) -> DataFrame:
    """(group, share, value): interpolated percentiles, exact. Null values take no part.

    A group's span is cut into ranges of equal width; counts of ranges say which of them hold the wanted ranks, and
    only the values of those ranges are grouped and ranked. Equal values count once with their number, so ties make no large range.
    """
    written = Written(samples.sparkSession)
    held = samples.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"))
    span = written(held.groupBy("g").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("total")).where("g is not null"))
    groups = span.count()
    place = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * ranges), F.lit(ranges - 1))
    placed = held.join(joinable(span, groups), "g").select("g", "x", F.when(F.col("high") > F.col("low"), place).otherwise(0).alias("range"))
    sums = placed.groupBy("g", "range").agg(F.count("*").alias("in_range"))
    so_far = W.partitionBy("g").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sums.withColumn("before", F.sum("in_range").over(so_far) - F.col("in_range"))
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    at = F.col("share") * (F.col("total") - 1)
    # Of each share the two ranks around its place.
    ranks = span.select("g", "total", asked).select("g", "share", at.alias("at"), F.explode(F.array(F.floor(at), F.ceil(at))).alias("rank"))
    holding = ranks.join(sums, "g").where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("in_range"))).select("g", "share", "at", "rank", "range", "before").distinct()
    holding = written(holding)
    wanted = joinable(holding.select("g", "range").distinct(), groups * 2 * len(shares))
    inside = W.partitionBy("g", "range").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = placed.join(wanted, ["g", "range"], "left_semi").groupBy("g", "range", "x").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(inside))
    hit = near.join(holding, ["g", "range"]).where((F.col("rank") - F.col("before") < F.col("upto")) & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("n")))
    weight = F.when(F.floor("at") == F.ceil("at"), 1.0).when(F.col("rank") == F.floor("at"), F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    return hit.groupBy(F.col("g").alias(group), "share").agg(F.sum(F.col("x") * weight).alias("value"))


# Metrics by name, each with the event that it counts (* for all), its label column, and what it adds up (a column or nothing).
CATALOGUE = (
    ("tile_reads_total", "view", "", ""), ("tile_writes_total", "purchase", "", ""), ("tile_deletes_total", "error", "", ""), ("tile_read_latency", "view", "", "value"), ("tile_write_latency", "purchase", "", "value"),
    ("operation_errors_total", "error", "kind", ""), ("cache_hits_total", "click", "", ""), ("cache_misses_total", "error", "", ""), ("query_latency", "*", "", "value"), ("revision_commits_total", "purchase", "", ""),
    ("revision_checkouts_total", "view", "", ""), ("gc_runs_total", "error", "", ""), ("gc_tiles_freed", "error", "", "cell"), ("gc_duration_seconds", "error", "", "value"), ("recovery_runs_total", "signup", "", ""),
    ("recovery_success_total", "purchase", "", ""), ("recovery_failure_total", "error", "", ""), ("recovery_duration_seconds", "signup", "", "value"), ("store_tiles_total", "*", "", ""), ("store_segments_total", "signup", "", ""),
    ("store_size_bytes", "*", "", "seq"), ("store_compressed_bytes", "*", "", "cell"), ("active_operations", "click", "", ""), ("compute_budget_remaining", "view", "", "value"), ("memory_reads_total", "view", "kind", ""),
    ("memory_writes_total", "purchase", "kind", ""), ("memory_entries_total", "*", "kind", ""), ("cache_size_bytes", "*", "kind", "value"),
)

#: The catalogue's samples of a log (seq, cell, event_type, value) in SQL; a kind is an event type and whether its key is even.
SAMPLES_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS metric, {label} AS label, COUNT(*) AS count, CAST(SUM({column or 0}) AS DOUBLE) AS value FROM {{access_log}}" + (f" WHERE event_type = '{event}'" if event != "*" else "") + " GROUP BY 2"
    for name, event, kind, column in CATALOGUE
    for label in ("event_type || CAST(cell % 2 AS STRING)" if kind else "''",)
)


def catalogue(log: DataFrame) -> DataFrame:
    """(metric, label, count, value) of every metric of the catalogue.

    The log is summed once by event type and kind, which is small; each metric is then a row's sums.
    """
    sums = log.groupBy("event_type", F.concat("event_type", (F.col("cell") % 2).cast("string")).alias("kind")).agg(F.count("*").alias("n"), *[F.sum(c).cast("double").alias(f"sum_{c}") for c in ("value", "cell", "seq")])
    rows = [F.struct(F.lit(name).alias("metric"), (F.col("kind") if kind else F.lit("")).alias("label"), F.lit(event).alias("event"), (F.col(f"sum_{column}") if column else F.lit(0.0)).alias("value")) for name, event, kind, column in CATALOGUE]
    each = sums.select("event_type", "n", F.explode(F.array(*rows)).alias("m")).where("m.event = '*' or m.event = event_type")
    return each.groupBy("m.metric", "m.label").agg(F.sum("n").alias("count"), F.sum("m.value").alias("value"))


def exported(metrics: DataFrame) -> DataFrame:
    """(metric, label, line): one line of text for each count."""
    shown = F.when(F.col("label") == "", "").otherwise(F.concat(F.lit('{label="'), "label", F.lit('"}')))
    return metrics.select("metric", "label", F.concat("metric", shown, F.lit(" "), F.col("count").cast("string")).alias("line"))

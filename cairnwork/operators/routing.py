"""Policy-based selection of cells and statistics of their use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars


def matches(keywords: str):
    """Any keyword occurs in cell_type; no keywords match everything."""
    words = keywords.lower().split()
    return F.greatest(*[F.col("cell_type").contains(w) for w in words], F.lit(False)) if words else F.lit(True)


def _policy(cells: DataFrame, policy: str, wanted) -> DataFrame:
    if policy == "Local":
        return cells.where(F.col("is_local") & wanted)
    if policy == "Remote":
        return cells.where(~F.col("is_local") & wanted)
    if policy == "Auto":
        fit = cells.where(wanted)
        any_local = fit.agg(F.coalesce(F.bool_or("is_local"), F.lit(False)).alias("any_local"))
        return fit.crossJoin(F.broadcast(any_local)).where(F.col("is_local") == F.col("any_local")).drop("any_local")
    first = {"LoadBalanced": "access_count", "LowestLatency": "latency_us"}[policy]
    return cells.orderBy(first, "hash").limit(10).where(wanted)


def route(cells: DataFrame, policy: str, keywords: str = "") -> DataFrame:
    """Cells that the policy picks among those that match; all that it picks if none matches."""
    picked = _policy(cells, policy, matches(keywords))
    if not keywords.split():
        return picked
    none = picked.agg((F.count("*") == 0).alias("none"))
    return picked.unionByName(_policy(cells, policy, F.lit(True)).crossJoin(F.broadcast(none)).where("none").drop("none"))


def select_topk(cells: DataFrame, similarity, k: int) -> DataFrame:
    confidence = scalars.confidence(F.col("selections"), F.col("successes"))
    score = scalars.combined_score(similarity, confidence, scalars.recency(F.col("age_hours")))
    return cells.select("hash", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "hash").limit(k)


def usage(log: DataFrame) -> DataFrame:
    return log.groupBy("cell").agg(
        F.count("*").alias("selections"), F.sum("success").alias("successes"), F.round(F.avg("success"), 6).alias("success_rate"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("seq").alias("last_step")
    )


def running(log: DataFrame) -> DataFrame:
    so_far = W.partitionBy("cell").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return log.select("seq", "cell", F.round(F.avg("value").over(so_far), 9).alias("mean_value"), F.round(F.avg("success").over(so_far), 9).alias("success_rate"))


def edges(log: DataFrame) -> DataFrame:
    """Counts of what follows what in each cell's log."""
    pairs = log.select(F.col("event_type").alias("a"), F.lead("event_type").over(W.partitionBy("cell").orderBy("seq")).alias("b"), "success")
    return pairs.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("times"), F.sum("success").alias("successes"))

"""Memory-like records: search, scoring, decay, retention, consolidation. Times are given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars


def vector_search(rows: DataFrame, query: DataFrame, k: int, id_column: str, vector: str = "embedding") -> DataFrame:
    """The k rows nearest to the one row of query (column q) by cosine, then by id. Exact: every row is scored once."""
    scored = rows.crossJoin(F.broadcast(query.limit(1))).select(id_column, F.round(scalars.cosine(F.col(vector), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), id_column).limit(k)


def text_search(memory: DataFrame, words: str, memory_type: int | None = None) -> DataFrame:
    low = words.lower()
    hit = F.lower("key").contains(low) | F.lower("value").contains(low) | F.lower("lang").contains(low)
    alive = memory.where(F.col("lifecycle") != "Forgotten")
    return (alive if memory_type is None else alive.where(F.col("memory_type") == memory_type)).where(hit)


def decay(memory: DataFrame, rate: float, times: int = 1) -> DataFrame:
    """importance and lifecycle after so many decays at one moment; each starts from the last."""
    for _ in range(times):
        memory = memory.withColumn("importance", scalars.decayed(F.col("importance"), F.col("age_hours"), rate))
        memory = memory.withColumn("lifecycle", scalars.lifecycle_after_decay(F.col("importance"), F.col("lifecycle")))
    return memory


def touch_all(memory: DataFrame, touches: DataFrame) -> DataFrame:
    """A log of touches (id) folded into access_count, importance and lifecycle."""
    counted = touches.groupBy("id").agg(F.count("*").alias("times"))
    joined = memory.join(counted, "id", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    woken = F.when((F.col("times") > 0) & F.col("lifecycle").isin("Created", "Archived"), "Active").otherwise(F.col("lifecycle"))
    return joined.withColumns({"access_count": F.col("access_count") + F.col("times"), "importance": scalars.touched_importance(F.col("importance"), F.col("times")), "lifecycle": woken}).drop("times")


def working_set(log: DataFrame, capacity: int, keys: list[str], item: str, order: str) -> DataFrame:
    """For each key the capacity items used last, each at its last use."""
    last = log.groupBy(*keys, item).agg(F.max(order).alias("last_use"))
    recent = W.partitionBy(*keys).orderBy(F.col("last_use").desc(), item)
    return last.withColumn("place", F.row_number().over(recent)).where(F.col("place") <= capacity)


def consolidated_vectors(memory: DataFrame, group: Column, vector: str = "embedding", weight: str = "importance") -> DataFrame:
    """Weighted mean of each place of the vectors of a group: (grp, pos, mean)."""
    each = memory.where(F.col(vector).isNotNull()).select(group.alias("grp"), weight, F.posexplode(vector))
    return each.groupBy("grp", "pos").agg((F.sum(F.col(weight) * F.col("col")) / F.sum(weight)).alias("mean"))


def admit_within(rows: DataFrame, budget: int, keys: list[str], order: list[Column], size: str) -> DataFrame:
    """For each key the longest prefix in the order whose sizes stay within the budget."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("running", F.sum(size).over(before)).where(F.col("running") <= budget)

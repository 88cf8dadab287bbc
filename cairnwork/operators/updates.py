"""A log of learning updates of nine kinds, folded into the state that it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cache_tier

# Kinds of updates by code.
KINDS = ("NewPattern", "PatternUpdate", "CellMerge", "TileMerge", "RoutingOptimization", "CacheOptimization", "Consolidation", "CellRefinement", "CellCreate")
#: A halved average no longer holds what is so many updates behind, in double precision.
HALVINGS = 64


def folded_patterns(log: DataFrame) -> DataFrame:
    """(pattern, frequency, compute): the last NewPattern of each id, with the PatternUpdates after it.

    Frequencies add up. compute is ((first + a) / 2 + b) / 2 ...: the k-th update from the end counts 2^-k, so only the
    last HALVINGS are looked at, however many there are.
    """
    starts = log.where("kind = 0").groupBy("pattern").agg(F.max_by(F.struct("seq", "frequency", "compute"), "seq").alias("s"))
    later = log.where("kind = 1").join(starts, "pattern").where(F.col("seq") > F.col("s.seq"))
    added = later.groupBy("pattern").agg(F.sum("frequency").alias("more"), F.count("*").alias("n"))
    back = F.row_number().over(W.partitionBy("pattern").orderBy(F.col("seq").desc()))
    recent = later.select("pattern", "compute", back.alias("back")).where(F.col("back") <= HALVINGS).groupBy("pattern").agg(F.sum(F.col("compute") * F.pow(F.lit(0.5), F.col("back"))).alias("recent"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = starts.join(added, "pattern", "left").join(recent, "pattern", "left")
    return joined.select("pattern", (F.col("s.frequency") + zero("more")).alias("frequency"), (F.col("s.compute") * F.pow(F.lit(0.5), zero("n")) + zero("recent")).alias("compute"))


def applied(log: DataFrame) -> DataFrame:
    """(state, key, n, value) after a log (seq, kind, pattern, frequency, compute, confidence, cell, other); cells are cell and, where not null, other.

    pattern: frequency and average compute; cell_refs and tile_refs: how often merged; routing_hint: frequency times
    confidence, added up; cache_hint: the tier that the last one says; consolidation: updates of two cells or more by their
    first cell; replay_buffer and affected: the cells of refinements and creations.
    """
    cells = log.select("*", F.explode(F.when(F.col("other").isNull(), F.array("cell")).otherwise(F.array("cell", "other"))).alias("each"))
    state = lambda df, name, n, value: df.select(F.lit(name).alias("state"), F.col("key").cast("long").alias("key"), F.expr(n).cast("long").alias("n"), F.expr(value).cast("double").alias("value"))
    counted = lambda kind: cells.where(F.col("kind") == kind).groupBy(F.col("each").alias("key")).agg(F.count("*").alias("c"))
    hints = cells.where("kind = 4").groupBy(F.col("each").alias("key")).agg(F.count("*").alias("c"), F.sum(F.col("frequency") * F.col("confidence")).alias("v"))
    tiers = cells.where("kind = 5").groupBy(F.col("each").alias("key")).agg(F.max_by("frequency", "seq").alias("f")).withColumn("tier", cache_tier(F.col("f")))
    pairs = log.where("kind = 6 and other is not null").groupBy(F.col("cell").alias("key")).agg(F.count("*").alias("c"), F.max_by("confidence", "seq").alias("v"))
    parts = [
        state(folded_patterns(log).withColumnRenamed("pattern", "key"), "pattern", "frequency", "compute"),
        state(counted(2), "cell_refs", "c", "null"),
        state(counted(3), "tile_refs", "c", "null"),
        state(hints, "routing_hint", "c", "v"),
        state(tiers, "cache_hint", "tier", "null"),
        state(pairs, "consolidation", "c", "v"),
        state(counted(7), "replay_buffer", "1", "null"),
        state(counted(8), "affected", "1", "null"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out

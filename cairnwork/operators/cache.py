"""Cache behaviour replayed from access logs (cell = shard of the cache)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cache_tier


def level_stats(log: DataFrame) -> DataFrame:
    used = log.groupBy("cell").agg(F.count("*").alias("uses")).withColumn("level", cache_tier(F.col("uses")))
    levels = used.groupBy("level").agg(F.count("*").alias("entries"), F.sum("uses").alias("uses"))
    total = levels.agg(F.sum("uses").alias("total"))
    return levels.crossJoin(F.broadcast(total)).select("level", "entries", "uses", F.round(F.col("uses") / F.col("total"), 6).alias("share"))


def reuse_distance(log: DataFrame, rows_each: int = 256) -> DataFrame:
    """For each repeated access the distinct items used in its shard since the last: what an LRU needs to hold.

    An item's accesses since then are counted by their last one only: access b counts for a = (before, seq) if b is in
    between and the next access of b's item is not. So the distance is the number of accesses in between less those
    whose next access is in between too, which is a count of nested pairs (before', seq') within (before, seq).
    Accesses of a shard are numbered and cut into blocks; whole blocks are counted from sums over pairs of blocks, and
    only the two blocks at the ends are compared access by access, so a busy shard costs its accesses times a block.
    """
    own = W.partitionBy("cell", "item").orderBy("seq")
    numbered = store_numbers(log)
    marked = numbered.withColumn("before", F.lag("nth").over(own))
    pairs = marked.where("before is not null").select("seq", "cell", F.col("before").alias("lo"), F.col("nth").alias("hi"))
    block = lambda c: F.floor(F.col(c) / rows_each)
    pairs = pairs.withColumns({"lo_block": block("lo"), "hi_block": block("hi")})
    # Nested pairs: lo < lo' and hi' < hi. By the block of lo': those after lo's block whole, lo's own block one by one.
    same = pairs.select("cell", F.col("lo_block").alias("at"), F.col("lo").alias("in_lo"), F.col("hi").alias("in_hi"))
    one_by_one = pairs.join(same, (pairs.cell == same.cell) & (pairs.lo_block == same.at)).where("in_lo > lo and in_hi < hi")
    first = one_by_one.groupBy("seq").agg(F.count("*").alias("in_first"))
    # After lo's block: those that end before hi's block, from sums, and those that end in hi's block, one by one.
    ends = pairs.select("cell", F.col("hi_block").alias("at"), F.col("lo_block").alias("in_lo_block"), F.col("hi").alias("in_hi"))
    last_by_one = pairs.where("hi_block > lo_block").join(ends, (pairs.cell == ends.cell) & (pairs.hi_block == ends.at)).where("in_lo_block > lo_block and in_hi < hi")
    last = last_by_one.groupBy("seq").agg(F.count("*").alias("in_last"))
    cells = pairs.groupBy("cell", "lo_block", "hi_block").agg(F.count("*").alias("n"))
    wanted = pairs.where("hi_block > lo_block + 1").select("cell", "lo_block", "hi_block").distinct()
    inner = cells.select("cell", F.col("lo_block").alias("a"), F.col("hi_block").alias("b"), "n")
    whole = wanted.join(inner, "cell").where("a > lo_block and b < hi_block").groupBy("cell", "lo_block", "hi_block").agg(F.sum("n").alias("in_whole"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = pairs.join(first, "seq", "left").join(last, "seq", "left").join(whole, ["cell", "lo_block", "hi_block"], "left")
    between = F.col("hi") - F.col("lo") - 1
    return joined.select("seq", "cell", (between - zero("in_first") - zero("in_last") - zero("in_whole")).cast("long").alias("distance"))


def store_numbers(log: DataFrame, rows_each: int = 4096) -> DataFrame:
    """log with ``nth``, the number of each access in its shard, without a task that holds a busy shard: ranges of seq are counted apart."""
    ranged = log.withColumn("range", F.floor(F.col("seq") / rows_each))
    counts = ranged.groupBy("cell", "range").agg(F.count("*").alias("n"))
    so_far = W.partitionBy("cell").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = counts.select("cell", "range", (F.sum("n").over(so_far) - F.col("n")).alias("n_before"))
    inside = W.partitionBy("cell", "range").orderBy("seq")
    return ranged.withColumn("nth", F.row_number().over(inside) - 1).join(before, ["cell", "range"]).withColumn("nth", F.col("nth") + F.col("n_before")).drop("range", "n_before")


def eviction_plan(entries: DataFrame, needed: int) -> DataFrame:
    """For each shard the entries used longest ago until their sizes reach what is needed."""
    oldest = W.partitionBy("cell").orderBy("last_use", "item").rowsBetween(W.unboundedPreceding, W.currentRow)
    return entries.withColumn("freed", F.sum("size").over(oldest)).where(F.col("freed") - F.col("size") < needed).select("cell", "item", "freed")


def lru_replay(log: DataFrame, capacity: int) -> DataFrame:
    """(cell, hits, misses, evictions) of an LRU of so many bytes in each shard; a shard's log is replayed in order."""

    def replay(frame: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        hits = misses = evicted = 0
        for row in frame.sort_values("seq").itertuples():
            if row.item in held:
                hits += 1
                held[row.item] = held.pop(row.item)
                continue
            misses += 1
            while held and sum(held.values()) + row.size > capacity:
                held.pop(next(iter(held)))
                evicted += 1
            held[row.item] = row.size
        return pd.DataFrame([(frame.cell.iloc[0], hits, misses, evicted)], columns=["cell", "hits", "misses", "evictions"])

    return log.groupBy("cell").applyInPandas(replay, "cell long, hits long, misses long, evictions long")

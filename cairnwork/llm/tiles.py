"""Candidate groups in tiles: every two members of a group meet in a task, and no task or row holds a whole large group."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shared items that one block of incidence() counts at a time.
BLOCK = 4096


def meetings(groups: DataFrame, tile: int) -> DataFrame:
    """(rep, piece, task, left, right) for groups (rep, piece): members whose task agrees meet, those on the left with those on the right.

    A group of one tile shares its task with others; tiles i <= j of a larger one meet in a task for each (i, j).
    """
    sizes = groups.groupBy("piece").agg(F.count("*").alias("size"))
    buckets = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(groups.count() / tile))
    last = F.ceil(F.col("size") / tile).cast("int") - 1
    placed = groups.join(sizes, "piece").withColumn("own", F.pmod(F.xxhash64("rep"), last + 1).cast("int"))
    met = placed.select("rep", "piece", "own", F.explode(F.sequence(F.lit(0), last)).alias("other"), (last > 0).alias("large"))
    key = F.when(F.col("large"), F.concat_ws(":", "piece", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.pmod(F.xxhash64("piece"), F.lit(buckets)).cast("string"))
    return met.select("rep", "piece", key.alias("task"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))


def incidence(items: list[np.ndarray]) -> np.ndarray:
    """How many items each two members share; the items of a member are different from one another."""
    n = len(items)
    owner = np.repeat(np.arange(n), [len(x) for x in items])
    return shared_counts(n, owner, np.concatenate([*items, np.zeros(0, items[0].dtype if n else np.uint64)]))


def shared_counts(n: int, owner: np.ndarray, item: np.ndarray) -> np.ndarray:
    """incidence() of n members from (owner, item) entries, in blocks of items; an item of one member counts for nothing."""
    _, item, times = np.unique(item, return_inverse=True, return_counts=True)
    several = times[item] > 1
    owner, item = owner[several], item[several]
    _, item = np.unique(item, return_inverse=True)
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    common = np.zeros((n, n), np.float32)
    last = int(item[-1]) + 1 if len(item) else 0
    for lo in range(0, last, BLOCK):
        a, b = np.searchsorted(item, (lo, lo + BLOCK))
        block = np.zeros((n, min(BLOCK, last - lo)), np.float32)
        block[owner[a:b], item[a:b] - lo] = 1
        common += block @ block.T
    return common


def least_in_component(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least index that its links reach."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new

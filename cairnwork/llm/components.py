"""Connected components by alternating large-star and small-star steps (joins and least neighbours only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def components(edges: DataFrame, rows_each: int | None = None) -> DataFrame:
    """(node, label) of every node in edges (a, b): the label is the least node of its component.

    Each round writes its edges to the shared folder; the number of rounds grows with the logarithm of the nodes.
    With rows_each, few edges go on in few partitions (one for so many rows), whatever the shuffles' number is.
    """
    few = lambda df: df.coalesce(max(1, -(-mark[0] // rows_each))) if rows_each and mark else df
    mark = None
    stars = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    written = Written(edges.sparkSession, keep=4)
    stars, seen = written(stars), None
    while True:
        mark = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        stars = few(stars)
        both = stars.select("a", "b").union(stars.select("b", "a"))
        # What a join needs of a hub is a table of its own, so that the hub's edges can be split between tasks.
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = written(few(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = few(large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)).distinct()
        stars = written(few(small))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(stars.select("b", "b").distinct())

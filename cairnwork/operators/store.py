"""A store of content-addressed tiles: identity, deduplication, packing, integrity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import content_hash


def with_ids(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    return payloads.withColumn("tile_hash", content_hash(F.col(payload)))


def deduplicated(payloads: DataFrame) -> DataFrame:
    """One row for each distinct payload: (tile_hash, size, dedup_count), size in bytes. Only hashes and sizes are shuffled."""
    sized = with_ids(payloads).select("tile_hash", F.octet_length("payload").cast("long").alias("size"))
    return sized.groupBy("tile_hash").agg(F.first("size").alias("size"), F.count("*").alias("dedup_count"))


def new_tiles(payloads: DataFrame, stored: DataFrame) -> DataFrame:
    """Payloads whose tile_hash is not stored yet, each once."""
    return with_ids(payloads).join(stored.select("tile_hash"), "tile_hash", "left_anti").dropDuplicates(["tile_hash"])


def store_stats(payloads: DataFrame) -> DataFrame:
    tiles = deduplicated(payloads)
    return tiles.agg(
        F.count("*").alias("tiles"),
        F.coalesce(F.sum("dedup_count"), F.lit(0)).alias("writes"),
        F.coalesce(F.sum(F.col("dedup_count") - 1), F.lit(0)).alias("dedup_hits"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("stored_bytes"),
        F.coalesce(F.sum(F.col("size") * F.col("dedup_count")), F.lit(0)).alias("written_bytes"),
    )


def running_bytes(tiles: DataFrame, order: str, size: str = "size", ranges: int = 256) -> DataFrame:
    """Bytes before each tile in the order of a hex hash, with no task that holds all tiles.

    The hash's first digits cut the order into ranges; a small window sums ranges, and one for each range its tiles.
    """
    cut = (F.conv(F.substring(order, 1, 4), 16, 10).cast("int") * ranges / 65536).cast("int")
    placed = tiles.withColumn("range", cut)
    sums = placed.groupBy("range").agg(F.sum(size).alias("bytes"))
    before = sums.select("range", (F.sum("bytes").over(W.orderBy("range")) - F.col("bytes")).alias("range_before"))
    inside = W.partitionBy("range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = placed.join(F.broadcast(before), "range")  # at most one row for each of the ranges
    return joined.withColumn("before", F.sum(size).over(inside) - F.col(size) + F.col("range_before")).drop("range", "range_before")


def segments(tiles: DataFrame, limit: int) -> DataFrame:
    """Tiles in hash order cut where their running bytes pass multiples of limit: (segment, tiles, bytes)."""
    placed = running_bytes(tiles, "tile_hash").withColumn("segment", F.floor(F.col("before") / limit).cast("long"))
    return placed.groupBy("segment").agg(F.count("*").alias("tiles"), F.sum("size").alias("bytes"))


def first_fit(tiles: DataFrame, limit: int, key: str = "shard") -> DataFrame:
    """Exact first-fit packing inside each shard, in order of tile_hash: (shard, tile_hash, segment, byte_offset)."""
    import pandas as pd

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        used: list[int] = []
        out = []
        for row in frame.sort_values("tile_hash").itertuples():
            at = next((i for i, u in enumerate(used) if u + row.size <= limit), None)
            if at is None:
                used.append(0)
                at = len(used) - 1
            out.append((row.shard, row.tile_hash, at, used[at]))
            used[at] += row.size
        return pd.DataFrame(out, columns=["shard", "tile_hash", "segment", "byte_offset"])

    return tiles.select(F.col(key).cast("long").alias("shard"), "tile_hash", F.col("size").cast("long").alias("size")).groupBy("shard").applyInPandas(pack, "shard long, tile_hash string, segment long, byte_offset long")


def verified(tiles: DataFrame) -> DataFrame:
    """(passed, tiles) for tiles with their stated hash."""
    return tiles.select((content_hash(F.col("payload")) == F.col("tile_hash")).alias("passed")).groupBy("passed").agg(F.count("*").alias("tiles"))


def row_tiles(matrices: DataFrame, rows: str, row_bytes: str, tile_bytes: int) -> DataFrame:
    """A row for each tile of whole matrix rows: tile_no, first_row, n_rows."""
    per_tile = F.greatest(F.floor(F.lit(tile_bytes) / F.col(row_bytes)), F.lit(1))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col(rows) - 1, per_tile))
    planned = matrices.where(F.col(rows) > 0).withColumn("per_tile", per_tile).withColumn("first_row", first)
    return planned.withColumn("tile_no", F.floor(F.col("first_row") / F.col("per_tile"))).withColumn("n_rows", F.least("per_tile", F.col(rows) - F.col("first_row"))).drop("per_tile")


def sparse_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (rev, parent) with ``similarity``: the products over shared cells of vectors (rev, cell, amount), over the product of the norms; 0 where a norm is 0. Pairs without a vector on a side are left out."""
    norms = vectors.groupBy("rev").agg(F.sqrt(F.sum(F.col("amount").cast("double") * F.col("amount"))).alias("norm"))
    mine = pairs.join(vectors.select("rev", "cell", F.col("amount").alias("x")), "rev")
    shared = mine.join(vectors.select(F.col("rev").alias("parent"), "cell", F.col("amount").alias("y")), ["parent", "cell"])
    dots = shared.groupBy("rev", "parent").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("dot"))
    both = pairs.join(norms.withColumnRenamed("norm", "own"), "rev").join(norms.select(F.col("rev").alias("parent"), F.col("norm").alias("its")), "parent").join(dots, ["rev", "parent"], "left")
    length = F.col("own") * F.col("its")
    return both.select("rev", "parent", F.when(length > 0, F.coalesce("dot", F.lit(0.0)) / length).otherwise(0.0).alias("similarity"))


def mismatched(tiles: DataFrame) -> DataFrame:
    """Tiles (payload, tile_hash) for quarantine: their bytes do not give their hash, or there are none; with the reason."""
    own = content_hash(F.col("payload"))
    reason = F.when(F.col("payload").isNull(), "no bytes").when(own != F.col("tile_hash"), "hash mismatch")
    return tiles.withColumn("reason", reason).where("reason is not null")


#: An access policy takes the tiles of all cells and keeps what may be read.
Policy = Callable[[DataFrame], DataFrame]


def FULL_CELL(tiles: DataFrame) -> DataFrame:
    return tiles


def in_range(column: str, first: object, last: object) -> Policy:
    return lambda tiles: tiles.where(F.col(column).between(first, last))


def top_k(k: int, keys: list[str], order: list[Column]) -> Policy:
    return lambda tiles: tiles.withColumn("policy_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("policy_place") <= k).drop("policy_place")


def matching(condition: Column) -> Policy:
    return lambda tiles: tiles.where(condition)


def migrated(cells: DataFrame) -> DataFrame:
    """Cells of a first-version manifest (cell_id, dtype, size, lifecycle) with the columns of the second."""
    return cells.select(
        "cell_id", "dtype", F.col("size").cast("long").alias("uncompressed_size"), F.lit(0).alias("compression"), F.lit(1).alias("major"), F.lit(0).alias("minor"),
        (F.col("lifecycle") != "Tombstone").alias("kept"), F.lit("2").alias("store_version"),
    )

"""The log queries as Structured Streaming: each takes a stream (or, in tests, a table) and gives a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def metric_windows(samples: DataFrame, width: str = "15 seconds", late: str = "1 minute", edges: tuple[float, ...] = (10, 50, 100, 250, 500)) -> DataFrame:
    """(ts, metric, value) as counters and cumulative buckets for each window."""
    buckets = [F.count_if(F.col("value") <= e).alias(f"le_{e:g}") for e in edges]
    grouped = samples.withWatermark("ts", late).groupBy(F.window("ts", width), "metric")
    return grouped.agg(F.count("*").alias("total"), F.sum("value").alias("value_sum"), *buckets)


def new_tiles(writes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(ts, payload) without repeats of a payload within the watermark."""
    return writes.withColumn("tile_hash", F.sha2(F.col("payload").cast("binary"), 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["tile_hash"])


def sessions(accesses: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(ts, id) as sessions of activity."""
    return accesses.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "id").agg(F.count("*").alias("accesses"))


def alerts(samples: DataFrame, limit: float, lasting: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """Metrics that stayed above the limit for a whole window."""
    grouped = samples.withWatermark("ts", late).groupBy(F.window("ts", lasting), "metric")
    return grouped.agg(F.min("value").alias("least"), F.count("*").alias("samples")).where(F.col("least") > limit)


def lru_hits(log: DataFrame, capacity: int) -> DataFrame:
    """(seq, cell, item) with whether each access hits an LRU of so many items in its cell; the state is that LRU."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for frame in frames:
            frame, hits = frame.sort_values("seq"), []
            for item in frame["item"]:
                hits.append(item in held)
                held = [x for x in held if x != item][-(capacity - 1) :] + [item] if capacity > 1 else [item]
            yield frame.assign(hit=hits)[["seq", "cell", "item", "hit"]]
        state.update((held,))

    return log.groupBy("cell").applyInPandasWithState(step, "seq long, cell long, item string, hit boolean", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def open_transactions(wal: DataFrame, late: str = "10 minutes", most: str = "1 hour") -> DataFrame:
    """(ts, txn, record_type): each transaction's counts within a session, which ends when nothing came for so long, so that its state ends too; open where none was committed."""
    sessions = wal.withWatermark("ts", late).groupBy(F.session_window("ts", most), "txn")
    counts = sessions.agg(F.count_if(F.col("record_type") == "Begin").alias("begun"), F.count_if(F.col("record_type") == "Commit").alias("committed"))
    return counts.withColumn("open", (F.col("begun") > 0) & (F.col("committed") == 0))

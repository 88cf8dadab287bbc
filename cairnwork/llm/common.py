"""Helpers that the training-data operators share: shared folder, text chunks, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Written, shared_dir

__all__ = ["Written", "shared_dir"]

#: One word, as every operator on words takes it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step holds at a time; a longer text is one step of its own.
CHUNK_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint, which outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def null_safe_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and each text's offset; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most limit bytes of text (or one row), with text_buffer() of each."""
    if not batch.num_rows:
        return
    data, offsets = text_buffer(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: An odd multiplier and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=8)
def _powers(bits: int, inverse: bool) -> np.ndarray:
    out = np.full(1 << bits, _INVERSE if inverse else _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    return _powers(max(16, int(n).bit_length()), inverse)[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class SpanHasher:
    """64-bit hashes of any spans of a byte or word array, from one running polynomial sum."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(len(values)), out=self.sums[1:])

    @classmethod
    def of_bytes(cls, data: np.ndarray, seed: int = 1) -> SpanHasher:
        return cls(_byte_values(seed)[data])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * powers(len(self.sums), True)[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(h)

    def windows(self, width: int) -> np.ndarray:
        """Of every span of one width."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = (self.sums[width:] - self.sums[:n]) * powers(len(self.sums), True)[:n]
        return mix(h)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each text's first word (one entry more than texts). Words never cross texts."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def owners(firsts: np.ndarray) -> np.ndarray:
    """For each item the number of its text, from each text's first item."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def numbered(docs: DataFrame, *others: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(row_id, text, others) with unique row_id in the order of doc_id, and what puts doc_id back into a result by row_id.

    Where doc_id is a whole number, never null and never repeated, it is the row_id itself. Else rows are numbered
    by doc_id (null first) and text, and each row counts as a document of its own. A null text is empty from here on.
    """
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids and docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        plain = docs.select(F.col("doc_id").cast("long").alias("row_id"), null_safe_text().alias("text"), *others)
        return plain, lambda result, renamed=None: result.withColumnsRenamed({"row_id": "doc_id", **(renamed or {})})
    ordered = docs.select("doc_id", null_safe_text().alias("text"), *(c for c in others if c != "doc_id")).sort("doc_id", "text")
    keyed = cut(ordered.select(F.monotonically_increasing_id().alias("row_id"), "*"))

    def back(result: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
        for column, name in {"row_id": "doc_id", **(renamed or {})}.items():
            names = keyed.select(F.col("row_id").alias(column), F.col("doc_id").alias(name))
            result = result.join(names, column).drop(column)
        return result

    return keyed.select("row_id", "text", *others), back

"""Small arrays as rows: what a chunk of documents sends to many tasks travels as one row for each task.

An entry names a place (row_id, at) and whatever a task must compare. Entries of a chunk that go to one task are one
row of arrays; so Spark shuffles and groups them, and tasks compare them as numpy columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def task_count(docs: DataFrame, bytes_each: int) -> int:
    """Tasks for the entries of all texts, so that a task's share does not grow with the input."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bytes_each))


def packed(task: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each task with the arrays of its entries."""
    order = np.argsort(task, kind="stable")
    task = task[order]
    heads = np.flatnonzero(np.r_[True, task[1:] != task[:-1]]) if len(task) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[heads, len(task)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(task[heads].astype(np.int64)), *lists], names=["task", *columns])


def unpacked(table: pa.Table, *names: str) -> list[np.ndarray]:
    """The entries of all rows of a task, end to end."""
    return [np.concatenate([np.zeros(0, table.schema.field(n).type.value_type.to_pandas_dtype()), *[c.flatten().to_numpy(zero_copy_only=False) for c in table.column(n).chunks]]) for n in names]


def by_row(row_id: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each row_id with the arrays of its places."""
    out = packed(row_id, **columns)
    return out.rename_columns(["row_id", *columns])


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together (the first key leads), and a mark on each group's first in that order."""
    order = np.lexsort(keys[::-1])
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, first


def gathered(places: DataFrame, *columns: str) -> DataFrame:
    """All arrays of a row_id end to end."""
    return places.groupBy("row_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in columns])


def placed(task: np.ndarray, row_id: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Like packed(), with row_id as a base for the row and 31 low bits for each entry; entries keep their order."""
    high = row_id >> 31
    order = np.lexsort((high, task))
    task, high = task[order], high[order]
    heads = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (high[1:] != high[:-1])]) if len(task) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[heads, len(task)], pa.int32())
    columns = {"low": (row_id & 0x7FFFFFFF).astype(np.int32), **columns}
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(task[heads].astype(np.int64)), pa.array(high[heads] << 31), *lists], names=["task", "base", *columns])


def row_ids(table: pa.Table) -> np.ndarray:
    """The row_id of each entry of placed()."""
    (low,) = unpacked(table, "low")
    counts = table.column("low").combine_chunks()
    counts = pa.compute.list_value_length(counts).to_numpy(zero_copy_only=False).astype(np.int64) if table.num_rows else np.zeros(0, np.int64)
    return np.repeat(table.column("base").to_numpy(), counts) + low


PLACES = "task long, base long, low array<int>, at array<int>"


def sent_home(row_id: np.ndarray, at: np.ndarray, tasks: int) -> pa.RecordBatch:
    """Places on their way to a task for each share of the documents (schema PLACES)."""
    return placed(row_id % tasks, row_id, at=at)


def one_row_each(table: pa.Table) -> pa.Table:
    """All places of a document as one row (row_id, at)."""
    return pa.Table.from_batches([by_row(row_ids(table), at=unpacked(table, "at")[0])])

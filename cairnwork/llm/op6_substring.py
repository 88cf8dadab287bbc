"""Substring dedup with difference-cover anchors.

Places whose number in the document modulo PERIOD is in COVER form a difference cover: for any two places of two
documents some shift below PERIOD moves both onto it. So two equal windows of WINDOW words share an equal anchor of
ANCHOR words that starts on the cover in both. Anchors that occur once are settled by their hash; around the others
the match is extended to whole windows, which are compared by a 96-bit hash and by place.

Each chunk of documents sends only the first of its equal anchors and windows, so a passage that many documents share
reaches a task once for each chunk. Rows: one for each input row. Null and empty texts have no words; their kept text is
empty. Rows that share a doc_id, or have none, are documents of their own in the order of doc_id (null first) and text.
Other columns are not read. Words are compared by 64-bit hashes of two kinds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, chunks, numbered, owners, word_spans
from .exchange import PLACES, groups, one_row_each, placed, row_ids, sent_home, task_count, unpacked

WINDOW = 20
#: {0, 1, 3, 9} is a difference cover modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text whose anchors one task compares, about.
TASK_BYTES = 4 << 20

_ANCHORS = "task long, base long, low array<int>, at array<int>, hash array<int>, many array<boolean>"
_WINDOWS = "task long, base long, low array<int>, at array<int>, h1 array<long>, h2 array<int>, known boolean"


def _rows(part: pa.RecordBatch) -> np.ndarray:
    return part.column("row_id").to_numpy()


def _anchor_entries(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, tasks: int) -> Iterator[pa.RecordBatch]:
    starts, ends, firsts = word_spans(data, offsets)
    doc = owners(firsts)
    at = np.arange(len(starts)) - firsts[doc]
    hashes = SpanHasher(SpanHasher.of_bytes(data)(starts, ends)).windows(ANCHOR)
    length = np.diff(firsts)[doc]
    on = np.isin(at % PERIOD, COVER) & (at + ANCHOR <= length) & (length >= WINDOW)
    places = np.flatnonzero(on)
    h, row, at = hashes[places], _rows(part)[doc[places]], at[places].astype(np.int32)
    order, first = groups(h)
    heads = np.flatnonzero(first)
    size = np.diff(np.r_[heads, len(order)])
    many = np.zeros(len(h), bool)
    many[order] = np.repeat(size > 1, size)
    send = np.sort(order[heads])
    # A task sees few anchors, so 32 bits of the hash that chose the task tell them apart; windows are compared in full.
    yield placed((h[send] % np.uint64(tasks)).astype(np.int64), row[send], at=at[send], hash=(h[send] >> np.uint64(32)).astype(np.uint32).view(np.int32), many=many[send])
    here = np.flatnonzero(many)
    home = placed(row[here] % tasks, row[here], at=at[here])
    lists = [pa.array([[]] * home.num_rows, pa.list_(pa.int32())), pa.array([[]] * home.num_rows, pa.list_(pa.bool_()))]
    yield pa.RecordBatch.from_arrays([*home.columns, *lists], names=[*home.schema.names, "hash", "many"])


def _repeated_anchors(table: pa.Table, tasks: int) -> pa.Table:
    """Places of anchors that occur more than once; entries without a hash are known to and pass."""
    settled = pc.equal(pc.list_value_length(table.column("hash")), 0)
    passed = table.filter(settled)
    out = [sent_home(row_ids(passed), unpacked(passed, "at")[0], tasks)]
    table = table.filter(pc.invert(settled))
    row, (at, h, many) = row_ids(table), unpacked(table, "at", "hash", "many")
    order, first = groups(h)
    size = np.diff(np.r_[np.flatnonzero(first), len(order)])
    several = order[np.repeat(size, size) > 1]
    several = np.sort(several[~many[several]])
    return pa.Table.from_batches([*out, sent_home(row[several], at[several], tasks)])


def _window_entries(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, tasks: int) -> Iterator[pa.RecordBatch]:
    anchors = part.column("at")
    starts, ends, firsts = word_spans(data, offsets)
    near = np.zeros(len(starts) + 1, np.int64)
    counts = np.diff(anchors.offsets.to_numpy()) if len(anchors) else np.zeros(0, np.int64)
    base = np.repeat(firsts[:-1], counts)
    place = base + anchors.flatten().to_numpy(zero_copy_only=False)
    np.add.at(near, np.maximum(place - (WINDOW - ANCHOR), base), 1)
    np.add.at(near, place + 1, -1)
    doc = owners(firsts)
    at = np.arange(len(starts)) - firsts[doc]
    window = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (at + WINDOW <= np.diff(firsts)[doc]))
    h1, h2 = (SpanHasher(SpanHasher.of_bytes(data, seed)(starts, ends)).windows(WINDOW)[window] for seed in (1, 2))
    row, at = _rows(part)[doc[window]], at[window].astype(np.int32)
    order = np.lexsort((at, row, h2, h1))
    first = np.ones(len(order), bool)
    first[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    send, later = np.sort(order[first]), np.sort(order[~first])
    for places, known in ((send, False), (later, True)):
        task = row[places] % tasks if known else (h1[places] % np.uint64(tasks)).astype(np.int64)
        batch = placed(task, row[places], at=at[places]) if known else placed(task, row[places], at=at[places], h1=h1[places].view(np.int64), h2=(h2[places] >> np.uint64(32)).astype(np.uint32).view(np.int32))
        if known:
            lists = [pa.array([[]] * batch.num_rows, pa.list_(kind)) for kind in (pa.int64(), pa.int32())]
            batch = pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "h1", "h2"])
        yield batch.append_column("known", pa.array(np.full(batch.num_rows, known)))


def _later_windows(table: pa.Table, tasks: int) -> pa.Table:
    """Places of windows whose words also start earlier; rows marked known are such places and pass."""
    passed = table.filter(table.column("known"))
    out = [sent_home(row_ids(passed), unpacked(passed, "at")[0], tasks)]
    table = table.filter(pc.invert(table.column("known")))
    row, (at, h1, h2) = row_ids(table), unpacked(table, "at", "h1", "h2")
    order = np.lexsort((at, row, h2, h1))
    later = np.zeros(len(order), bool)
    later[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    later = np.sort(order[later])
    return pa.Table.from_batches([*out, sent_home(row[later], at[later], tasks)])


def _kept(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    windows = part.column("at")
    starts, ends, firsts = word_spans(data, offsets)
    cover = np.zeros(len(starts) + 1, np.int64)
    counts = np.diff(windows.offsets.to_numpy()) if len(windows) else np.zeros(0, np.int64)
    place = np.repeat(firsts[:-1], counts) + windows.flatten().to_numpy(zero_copy_only=False)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + WINDOW, -1)
    stay = np.cumsum(cover[:-1]) == 0
    width = (ends - starts + 1)[stay]
    total = np.r_[0, np.cumsum(width)]
    source = np.repeat(starts[stay] - total[:-1], width) + np.arange(total[-1])
    text = np.r_[data, np.uint8(0x20)][source]
    text[total[1:] - 1] = 0x20
    left = np.r_[0, np.cumsum(stay)][firsts]
    cuts, raw = total[left], text.tobytes()
    kept = [raw[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    words = np.diff(firsts)
    return pa.RecordBatch.from_arrays([part.column("row_id"), pa.array(words, pa.int64()), pa.array(words - np.diff(left), pa.int64()), pa.array(kept, pa.binary())], names=["row_id", "n_words", "n_removed", "kept"])


def _with_lists(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Absent lists as empty ones."""
    column = batch.column("at")
    counts = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), column.flatten())
    return batch.set_column(batch.schema.get_field_index("at"), "at", lists)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(row_id, n_words, n_removed, kept) for docs (row_id unique, text); kept is UTF-8."""
    tasks = task_count(docs, TASK_BYTES)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                yield from _anchor_entries(part, data, offsets, tasks)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("at")))
            for part, data, offsets in chunks(batch):
                yield from _window_entries(_with_lists(part), data, offsets, tasks)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                yield _kept(_with_lists(part), data, offsets)

    def home(found: DataFrame) -> DataFrame:
        return found.groupBy("task").applyInArrow(one_row_each, "row_id long, at array<int>")

    repeated = docs.mapInArrow(anchors, _ANCHORS).groupBy("task").applyInArrow(lambda table: _repeated_anchors(table, tasks), PLACES)
    # Both joins are left joins, so that one shuffle of the texts serves them.
    near = docs.join(home(repeated), "row_id", "left")
    later = near.mapInArrow(windows, _WINDOWS).groupBy("task").applyInArrow(lambda table: _later_windows(table, tasks), PLACES)
    return docs.join(home(later), "row_id", "left").mapInArrow(kept, "row_id long, n_words long, n_removed long, kept binary")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, back = numbered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return back(remove_repeats(docs)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_substring": op6_substring}
ORACLES: dict[str, str] = {
    "op6_substring": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, unnest(list_transform(range(0, greatest(len(ws) - 19, 0)), lambda i: struct_pack(p := i, win := array_to_string(ws[i + 1:i + 20], ' ')))) AS x FROM w),
f AS (SELECT doc_id, x.p AS p, row_number() OVER (PARTITION BY x.win ORDER BY doc_id, x.p) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM f WHERE nth > 1),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM w),
r AS (SELECT t.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY t.i) AS kept FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""
}

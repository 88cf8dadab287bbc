"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts elsewhere are removed.

Shards: every start belongs to the least 64-byte gram (by hash) of its string, so equal strings belong to equal grams.
The starts that belong to one gram are one piece of the document. Pieces that are equal are settled by their hashes;
only where a gram stands in different pieces do those pieces' bytes, once each, go to the gram's shard. A shard sorts
the suffixes of its pieces by induced sorting and keeps starts whose permuted common prefix reaches LENGTH. A gram in
more than HOT different pieces is compared by 128-bit hashes of its strings instead, which spread over all tasks.

Each chunk of documents sends only the first of its equal pieces. Rows: one for each input row. Null and empty texts
have no bytes. Rows that share a doc_id, or have none, are documents of their own in the order of doc_id (null first)
and text. Other columns are not read. Matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, chunks, cut, numbered
from .exchange import by_row, gathered, groups, packed, task_count, unpacked
from .suffix_array import repeated

LENGTH = 200
GRAM = 64
HOT = 4096
#: Bytes of text whose pieces one task compares, about.
TASK_BYTES = 4 << 20

_PIECES = "task long, row_id array<long>, at array<int>, n array<int>, h1 array<long>, h2 array<long>, many array<boolean>"
_FOUND = "row_id long, kind int, at array<int>, n array<int>, shard array<long>"
_SHARDS = "task long, row_id array<long>, at array<int>, n array<int>, h1 array<long>, h2 array<long>, data binary"
_STARTS = "row_id long, at array<int>, n array<int>"


def least_grams(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every width keys in a row: running minima from both sides of blocks of that width."""
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[: len(keys)] = keys
    padded = padded.reshape(blocks, width)
    left = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(padded, axis=1).ravel()
    n = len(keys) - width + 1
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Document, first start, number of starts, gram hash and content hash of every piece."""
    none = np.zeros(0, np.int64)
    hasher = SpanHasher.of_bytes(data)
    grams = hasher.windows(gram)
    width = length - gram + 1
    if len(grams) < width:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    bits = np.uint64(max(24, len(data).bit_length()))
    least = least_grams((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), width)
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    limit = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
    valid = np.arange(len(place)) + length <= limit
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    end = valid.copy()
    end[:-1] &= ~valid[1:] | begin[1:]
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    doc = np.searchsorted(offsets, first, "right") - 1
    return doc, first, last - first + 1, grams[place[first]], hasher(first, last + length)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _piece_entries(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, tasks: int, length: int) -> Iterator[pa.RecordBatch]:
    doc, first, n, gram, content = pieces(data, offsets, length)
    row, at, n = part.column("row_id").to_numpy()[doc], (first - offsets[doc]).astype(np.int32), n.astype(np.int32)
    order, new = groups(gram, content)
    heads = np.flatnonzero(new)
    size = np.diff(np.r_[heads, len(order)])
    send = order[heads]
    yield packed((gram[send] % np.uint64(tasks)).astype(np.int64), row_id=row[send], at=at[send], n=n[send], h1=_signed(gram[send]), h2=_signed(content[send]), many=size > 1)
    here = order[np.repeat(size > 1, size)]
    none = np.zeros(len(here), np.int64)
    # A piece of no starts tells that these places are settled.
    yield packed(row[here] % tasks, row_id=row[here], at=at[here], n=-n[here], h1=none, h2=none, many=np.ones(len(here), bool))


def _settle(table: pa.Table, hot: int) -> pa.Table:
    """kind 0: starts that are repeated; kind 1: pieces to compare by bytes; kind 2: by hashes of their strings."""
    row, at, n, h1, h2, many = unpacked(table, "row_id", "at", "n", "h1", "h2", "many")
    out = []

    def tell(kind: int, row: np.ndarray, at: np.ndarray, n: np.ndarray, shard: np.ndarray) -> None:
        batch = by_row(row, at=at, n=n, shard=shard)
        out.append(batch.add_column(1, "kind", pa.array(np.full(batch.num_rows, kind, np.int32))))

    known = n < 0
    tell(0, row[known], at[known], -n[known], np.zeros(int(known.sum()), np.int64))
    row, at, n, h1, h2, many = (x[~known] for x in (row, at, n, h1, h2, many))
    order, new = groups(h1, h2)
    heads = np.flatnonzero(new)
    size = np.diff(np.r_[heads, len(order)])
    equal = order[np.repeat(size > 1, size)]
    equal = equal[~many[equal]]
    tell(0, row[equal], at[equal], n[equal], h1[equal])
    head = order[heads]
    gram_new = np.r_[True, h1[head][1:] != h1[head][:-1]] if len(head) else np.zeros(0, bool)
    kinds = np.diff(np.r_[np.flatnonzero(gram_new), len(head)])
    kinds = np.repeat(kinds, kinds)
    for kind, chosen in ((1, (kinds > 1) & (kinds <= hot)), (2, kinds > hot)):
        pick = head[chosen]
        tell(kind, row[pick], at[pick], n[pick], h1[pick])
    return pa.Table.from_batches(out)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and the number of them in each row (an absent list has none)."""
    column = batch.column(name)
    counts = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), counts


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... size times for each."""
    total = np.r_[0, np.cumsum(sizes)]
    return np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])


def _shard_entries(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, tasks: int, length: int) -> Iterator[pa.RecordBatch]:
    at, counts = _lists(part, "at")
    n, _ = _lists(part, "n")
    shard, _ = _lists(part, "shard")
    kinds, _ = _lists(part, "kinds")
    doc = np.repeat(np.arange(part.num_rows), counts)
    row, first = part.column("row_id").to_numpy()[doc], offsets[doc] + at
    sent = np.flatnonzero(kinds == 1)
    task = (shard[sent].view(np.uint64) % np.uint64(tasks)).astype(np.int64)
    order = np.argsort(task, kind="stable")
    sent, task = sent[order], task[order]
    none = np.zeros(len(sent), np.int64)
    batch = packed(task, row_id=row[sent], at=at[sent], n=n[sent], h1=none, h2=none)
    width = n[sent] + length - 1
    raw = data[_spread(first[sent], width)].tobytes()
    cuts = np.r_[0, np.cumsum(width)][np.r_[np.flatnonzero(np.r_[True, task[1:] != task[:-1]]) if len(task) else np.zeros(0, np.int64), len(task)]]
    yield batch.append_column("data", pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
    hot = np.flatnonzero(kinds == 2)
    if len(hot):
        places = _spread(first[hot], n[hot])
        h1, h2 = (SpanHasher.of_bytes(data, seed)(places, places + length) for seed in (1, 2))
        owner = np.repeat(doc[hot], n[hot])
        batch = packed((h1 % np.uint64(tasks)).astype(np.int64), row_id=part.column("row_id").to_numpy()[owner], at=(places - offsets[owner]).astype(np.int32), n=np.ones(len(places), np.int32), h1=_signed(h1), h2=_signed(h2))
        yield batch.append_column("data", pa.nulls(batch.num_rows, pa.binary()))


def _repeated_starts(table: pa.Table, length: int) -> pa.Table:
    """Starts of a shard's pieces, or of strings sent as hashes, that are repeated."""
    out = []
    by_hash = pc.is_null(table.column("data"))
    row, at, n, h1, h2 = unpacked(table.filter(by_hash), "row_id", "at", "n", "h1", "h2")
    order, new = groups(h1, h2)
    size = np.diff(np.r_[np.flatnonzero(new), len(order)])
    equal = order[np.repeat(size > 1, size)]
    out.append(by_row(row[equal], at=at[equal], n=n[equal]))
    table = table.filter(pc.invert(by_hash))
    row, at, n = unpacked(table, "row_id", "at", "n")
    if len(row):
        data = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8)
        width = n.astype(np.int64) + length - 1
        begin = np.r_[0, np.cumsum(width + 1)][:-1]
        text = np.full(int(width.sum()) + len(n) + 1, 1, np.uint16)
        text[_spread(begin, width)] = data.astype(np.uint16) + 2
        text[-1] = 0
        hit = repeated(text, length)
        places = _spread(begin, n.astype(np.int64))
        owner = np.repeat(np.arange(len(n)), n)
        found = hit[places]
        start = (places - begin[owner] + at[owner])[found]
        owner = owner[found]
        run = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]) if len(owner) else np.zeros(0, np.int64)
        out.append(by_row(row[owner[run]], at=start[run].astype(np.int32), n=np.diff(np.r_[run, len(owner)]).astype(np.int32)))
    return pa.Table.from_batches(out)


def _kept(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, length: int) -> pa.RecordBatch:
    at, counts = _lists(part, "at")
    n, _ = _lists(part, "n")
    first = np.repeat(offsets[:-1], counts) + at
    cover = np.zeros(len(data) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + n + length - 1, -1)
    gone = np.cumsum(cover[:-1]) > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    opens[edges] = gone[edges]
    removed, spans = (np.diff(np.r_[0, np.cumsum(x)][offsets]) for x in (gone, opens))
    left = np.r_[0, np.cumsum(~gone)][offsets]
    raw = data[~gone].tobytes()
    kept = [raw[a:b] for a, b in zip(left[:-1], left[1:], strict=True)]
    return pa.RecordBatch.from_arrays([part.column("row_id"), *(pa.array(x, pa.int64()) for x in (np.diff(offsets), removed, spans)), pa.array(kept, pa.binary())], names=["row_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(row_id, n_bytes, n_removed, n_spans, kept) for docs (row_id unique, text)."""
    tasks = task_count(docs, TASK_BYTES)

    def over_chunks(entries: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in chunks(batch):
                    result = entries(part, data, offsets)
                    yield from [result] if isinstance(result, pa.RecordBatch) else result

        return run

    def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch.filter(pc.is_valid(batch.column("at")))):
                yield from _shard_entries(part, data, offsets, tasks, length)

    sent = docs.mapInArrow(over_chunks(lambda *x: _piece_entries(*x, tasks, length)), _PIECES)
    found = cut(sent.groupBy("task").applyInArrow(lambda table: _settle(table, hot), _FOUND))
    asked = found.where("kind > 0").withColumn("kinds", F.array_repeat("kind", F.size("at")))
    # Both joins are left joins, so that one shuffle of the texts serves them.
    shards = docs.join(gathered(asked, "at", "n", "shard", "kinds"), "row_id", "left").mapInArrow(shard_rows, _SHARDS)
    starts = shards.groupBy("task").applyInArrow(lambda table: _repeated_starts(table, length), _STARTS)
    starts = starts.union(found.where("kind = 0").select("row_id", "at", "n"))
    joined = docs.join(gathered(starts, "at", "n"), "row_id", "left")
    return joined.mapInArrow(over_chunks(lambda *x: _kept(*x, length)), "row_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, back = numbered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return back(remove_repeats(docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_suffix": op2_suffix}
ORACLES: dict[str, str] = {
    "op2_suffix": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, unnest(list_transform(range(0, greatest(len(h) // 2 - 199, 0)), lambda i: struct_pack(p := i, win := md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400))))) AS x FROM h),
f AS (SELECT doc_id, x.p AS p, count(*) OVER (PARTITION BY x.win) AS n FROM k),
s AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER d + 200 THEN 1 ELSE 0 END AS new FROM f WHERE n > 1 WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM s),
r AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, run),
q AS (SELECT r.doc_id, a, b, substr(h, CAST(2 * lag(b, 1, 0) OVER d + 1 AS BIGINT), CAST(2 * (a - lag(b, 1, 0) OVER d) AS BIGINT)) AS piece FROM r JOIN h ON h.doc_id = r.doc_id WINDOW d AS (PARTITION BY r.doc_id ORDER BY a)),
g AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans FROM q GROUP BY doc_id)
SELECT h.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM h LEFT JOIN g ON g.doc_id = h.doc_id
"""
}

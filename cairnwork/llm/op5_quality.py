"""Quality classifier: a factorisation machine over hashed words, structure statistics and the n_chars metadata.

A document's score is w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2], put through the
logistic function: all pairwise interactions at linear cost. It is fitted on at most TRAIN_ROWS labelled rows outside
the held-out fold, the first by xxhash64(doc_id); every row is scored on its whole text.

Rows: one for each input row. A null text counts as empty; an empty text gets the score of its statistics alone. A
null doc_id is held out (it can have no label). Labels other than 0 and 1 are ignored; of several labels of one
document the greatest counts, and of several rows of one doc_id the first by text and n_chars is fitted on. Without usable labels every score is 0.5. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHasher, chunks, owners, word_spans

#: Bound on the labelled rows that the model is fitted on.
TRAIN_ROWS = 8_000
THRESHOLD = 0.3
_WORD_BITS = 15
_BINS = 16
_STATS = ("words", "length", "upper", "digit", "symbol", "wide", "newline", "unique", "top", "lines", "marked", "mean", "longest", "short")


def _of(characters: str) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[[ord(c) for c in characters]] = 1
    return out


_UPPER, _DIGIT = _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _of("0123456789")
_SYMBOL, _MARK = _of("!#$%&*+/<=>@[\\]^_`{|}~"), _of("!#$%&*+/<=>@[\\]^_`{|}~?")
_WIDE = np.r_[np.zeros(0xC0), np.ones(0x40)].astype(np.float32)
_CONTINUED = np.r_[np.zeros(0x80), np.ones(0x40), np.zeros(0x40)].astype(np.float32)


def _sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.float64)]
    return total[firsts[1:]] - total[firsts[:-1]]


def _peaks(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    out, full = np.zeros(len(firsts) - 1), np.diff(firsts) > 0
    if full.any():
        out[full] = np.maximum.reduceat(values, firsts[:-1][full])
    return out


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their values and each document's first feature, for documents end to end."""
    n = len(offsets) - 1
    starts, ends, firsts = word_spans(data, offsets)
    hashes = SpanHasher.of_bytes(data)(starts, ends)
    doc = owners(firsts)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    head = np.flatnonzero(new)
    counts = np.diff(np.r_[head, len(order)]).astype(np.float64)
    word_doc, word_hash = doc[order][head], hashes[order][head]
    word_firsts = np.searchsorted(word_doc, np.arange(n + 1))
    words, size = np.diff(firsts).astype(np.float64), np.maximum(np.diff(offsets), 1).astype(np.float64)
    any_words = np.maximum(words, 1)
    share = lambda table: _sums(table[data], offsets) / size
    width = (ends - starts).astype(np.float64) - (np.r_[0, np.cumsum(_CONTINUED[data])][ends] - np.r_[0, np.cumsum(_CONTINUED[data])][starts])
    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], (breaks + 1)[~np.isin(breaks + 1, offsets)])
    line_ends = np.r_[line_starts[1:], len(data)] if len(line_starts) else line_starts
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    long_line = (line_ends - line_starts) > 1
    line_key = SpanHasher.of_bytes(data)(line_starts[long_line], np.maximum(line_ends[long_line] - 1, line_starts[long_line]))
    line_owner = line_doc[long_line]
    line_count = np.bincount(line_owner, minlength=n)
    line_kinds = np.bincount((np.unique(np.stack([line_owner.astype(np.uint64), line_key]), axis=1)[0]).astype(np.int64), minlength=n) if len(line_key) else np.zeros(n)
    stats = {
        "words": np.log2(words + 1) / 16,
        "length": np.log2(np.maximum(n_chars, 0) + 1) / 20,
        "upper": np.sqrt(share(_UPPER)),
        "digit": np.sqrt(share(_DIGIT)),
        "symbol": np.sqrt(share(_SYMBOL)),
        "wide": np.sqrt(share(_WIDE)),
        "newline": np.sqrt(_sums(data == 10, offsets) / size),
        "unique": np.diff(word_firsts) / any_words,
        "top": np.sqrt(_peaks(counts, word_firsts) / any_words),
        "lines": line_kinds / np.maximum(line_count, 1),
        "marked": np.sqrt(_sums(_MARK[data[ends - 1]], firsts) / any_words) if len(ends) else np.zeros(n),
        "mean": np.log2(_sums(width, firsts) / any_words + 1) / 6,
        "longest": np.log2(_peaks(width, firsts) + 1) / 10,
        "short": _sums(width <= 2, firsts) / any_words,
    }
    ids, values, owner = [], [], []
    everyone = np.arange(n)
    for k, name in enumerate(_STATS):
        at = np.clip(stats[name], 0, 1) * (_BINS - 1)
        low = np.minimum(at.astype(np.int64), _BINS - 2)
        base = (1 << _WORD_BITS) + k * _BINS
        for shift, weight in ((0, 1 - (at - low)), (1, at - low)):
            ids.append(base + low + shift)
            values.append(weight)
            owner.append(everyone)
    norm = np.sqrt(np.maximum(_sums(counts**2, word_firsts), 1))
    ids.append((word_hash >> np.uint64(64 - _WORD_BITS)).astype(np.int64))
    values.append(counts / norm[word_doc])
    owner.append(word_doc)
    doc_of = np.concatenate(owner)
    order = np.argsort(doc_of, kind="stable")
    return np.concatenate(ids)[order], np.concatenate(values)[order].astype(np.float32), np.searchsorted(doc_of[order], np.arange(n + 1))


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, ids: np.ndarray, values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the factor sums. Each document has features."""
        scaled = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(scaled, firsts[:-1])
        squares = np.add.reduceat(scaled**2, firsts[:-1])
        linear = np.add.reduceat(self.weights[ids] * values, firsts[:-1])
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1), sums

    def score(self, ids: np.ndarray, values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, values, firsts)[0], -30, 30).astype(np.float64)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 8, epochs: int = 4, batch: int = 256, rate: float = 0.08, decay: float = 1e-5) -> FactorisationMachine:
    """Adagrad on the logistic loss; rows hold feature numbers, values and the label. Fixed seed: reruns agree."""
    size, random = (1 << _WORD_BITS) + len(_STATS) * _BINS, np.random.default_rng(7)
    model = FactorisationMachine(0.0, np.zeros(size, np.float32), random.normal(0, 0.02, (size, rank)).astype(np.float32))
    labels = np.array([y for *_, y in rows], np.float32)
    if not len(labels) or labels.min() == labels.max():
        model.factors[:] = 0
        model.bias = 0.0 if not len(labels) else float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
        return model
    model.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    bias_sum, weight_sum, factor_sum = 1e-6, np.full(size, 1e-6, np.float32), np.full((size, rank), 1e-6, np.float32)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            part = order[lo : lo + batch]
            ids, values = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            counts = np.array([len(rows[i][0]) for i in part])
            firsts = np.r_[0, np.cumsum(counts)]
            raw, sums = model.raw(ids, values, firsts)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) / len(part)
            each = np.repeat(error, counts) * values
            used, slot = np.unique(ids, return_inverse=True)
            step = np.bincount(slot, each, len(used)).astype(np.float32) + decay * model.weights[used]
            weight_sum[used] += step**2
            model.weights[used] -= rate * step / np.sqrt(weight_sum[used])
            pull = each[:, None] * (np.repeat(sums, counts, axis=0) - model.factors[ids] * values[:, None])
            step = np.stack([np.bincount(slot, pull[:, f], len(used)) for f in range(rank)], axis=1).astype(np.float32) + decay * model.factors[used]
            factor_sum[used] += step**2
            model.factors[used] -= rate * step / np.sqrt(factor_sum[used])
            bias_sum += float(error.sum()) ** 2
            model.bias -= rate * float(error.sum()) / bias_sum**0.5
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return np.nan_to_num(batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Fitted on the driver: max_rows bounds what it gathers."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    body = F.struct("text", F.col("n_chars").cast("double").alias("n_chars"))
    labelled = docs.select("doc_id", body.alias("body")).join(F.broadcast(sample), "doc_id")
    # Where rows share a doc_id the first by text counts, so the bound holds and reruns agree.
    chosen = labelled.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("body").alias("body")).select("doc_id", "body.*", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                ids, values, firsts = features(data, offsets, _numbers(part))
                lists = lambda x, kind, firsts=firsts: pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality").cast(pa.int32()), lists(ids, pa.int32()), lists(values, pa.float32())], names=["doc_id", "quality", "ids", "values"])

    table = chosen.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, ids array<int>, values array<float>").toArrow().sort_by("doc_id").combine_chunks()
    unpack = lambda name: [np.asarray(x.values) for x in table.column(name)]
    return fit(list(zip(unpack("ids"), unpack("values"), table.column("quality").to_pylist(), strict=True)))


def score(docs: DataFrame, model: FactorisationMachine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row, with ``score``."""
    needed = [*keep, *(c for c in ("text", "n_chars") if c not in keep)]
    body = docs.select(*needed)
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                result = pa.array(model.score(*features(data, offsets, _numbers(part))), pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), result], names=[*keep, "score"])

    return body.mapInArrow(run, T.StructType([*(f for f in schema.fields if f.name != "score"), T.StructField("score", T.DoubleType())]))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}

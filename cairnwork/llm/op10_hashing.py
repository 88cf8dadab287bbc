"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: several rotations learned on a bounded sample (projections, then alternating between signs
and the best rotation to them), a sign per axis, cut into SUBSTRINGS substrings of 64 bits. Every substring is an index
of its own, shuffled by (substring, shard of its value). Two codes within Hamming radius r agree in some substring to
within floor(r / SUBSTRINGS) bits, so a query visits, for each substring, the shards that hold a value within that ball
(all shards where the ball has more values than there are shards), looks its buckets up there, checks whole codes, and
takes inner products of the original vectors with what is left. A pair that several substrings find is taken in the
first of them. Queries that find fewer than k are searched again within the whole code length, which is exact.

A shard with many rows or queries is cut on both sides, each part of one meeting each part of the other in a task. Equal
vectors are one class with its k + 1 least vec_ids, which are all that any query can ask of it.

Rows: k (or as many as there are candidates) for each query. Vectors that are null, of another length than most rows
of the sample, zero, or with null or non-finite components take no part, and neither do rows without vec_id. Rows that
share a vec_id are one candidate (the first by its vector). Ties go to the smaller vec_id. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, cut

#: Bound on the rows that the rotations and the radius are learned on.
SAMPLE_ROWS = 4_000
SUBSTRINGS, WIDTH = 8, 64
BITS = SUBSTRINGS * WIDTH
#: Share of the sample's true neighbours that the radius must reach.
REACH = 0.97
#: Rows and queries that meet in one task, at most about.
ROWS_EACH, QUERIES_EACH = 1 << 16, 2048
#: Values of a ball that are looked up one by one, and queries of a task that are probed at once.
MOST_PROBES, AT_ONCE = 1 << 16, 64


@dataclass
class Coder:
    """Learned projections, one column for each of BITS bits, and the search radius."""

    mean: np.ndarray
    axes: np.ndarray
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, SUBSTRINGS) of 64-bit substrings."""
        return np.packbits((vectors - self.mean) @ self.axes > 0, axis=1).view(np.uint64)


def ball_size(radius: int) -> int:
    return sum(math.comb(WIDTH, n) for n in range(min(radius, WIDTH) + 1))


@lru_cache(maxsize=8)
def ball(radius: int) -> np.ndarray:
    """All substrings of at most so many set bits."""
    one = [1 << i for i in range(WIDTH)]
    return np.array([sum(c) for n in range(radius + 1) for c in combinations(one, n)], np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def learn(vectors: np.ndarray, k: int, share: float = 1.0, rounds: int = 25, reach: float = REACH) -> Coder:
    """Fitted on a sample that is this share of all rows, so that its k * share nearest stand for the k nearest of all (the nearest one at least)."""
    random = np.random.default_rng(5)
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, _, principal = np.linalg.svd(centred, full_matrices=True)
    each, axes = min(WIDTH, vectors.shape[1]), []
    while sum(a.shape[1] for a in axes) < BITS:
        # The first code stands on the principal axes, the others on random ones.
        base = np.linalg.qr(random.normal(size=(vectors.shape[1], each)))[0] if axes else principal.T[:, :each]
        turned = centred @ base
        turn = np.linalg.qr(random.normal(size=(each, each)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(turned @ turn).T @ turned)
            turn = (u @ w).T
        axes.append(base @ turn)
    coder = Coder(mean, np.concatenate(axes, axis=1)[:, :BITS], BITS)
    codes = coder.codes(vectors)
    probe = random.permutation(len(vectors))[:200]
    scores = vectors[probe] @ vectors.T
    scores[np.arange(len(probe)), probe] = -np.inf
    nearest = np.argsort(-scores, axis=1, kind="stable")[:, : min(max(1, math.ceil(k * share)), len(vectors) - 1)]
    found = distances(codes[probe][:, None, :], codes[nearest])
    if found.size:
        coder.radius = int(np.quantile(found, reach, method="higher"))
    return coder


def shard_of(values: np.ndarray, shards: int) -> np.ndarray:
    return ((values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def probed_shards(code: np.ndarray, radius: int, shards: int) -> list[tuple[int, int]]:
    """(substring, shard) of all that a query must visit."""
    near = radius // SUBSTRINGS
    if near >= WIDTH:
        return [(0, i) for i in range(shards)]
    if ball_size(near) > min(4 * shards, MOST_PROBES):
        return [(s, i) for s in range(SUBSTRINGS) for i in range(shards)]
    return [(s, int(i)) for s in range(SUBSTRINGS) for i in np.unique(shard_of(code[s] ^ ball(near), shards))]


class Buckets:
    """The rows of a shard by the value of one substring."""

    def __init__(self, codes: np.ndarray, substring: int):
        self.codes, self.substring = codes, substring
        self.rows = np.argsort(codes[:, substring], kind="stable")
        self.values, self.starts = np.unique(codes[self.rows, substring], return_index=True)
        self.sizes = np.diff(np.r_[self.starts, len(codes)])

    def probe(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the pairs within the radius that this substring is the first to find."""
        near = radius // SUBSTRINGS
        mine = codes[:, self.substring]
        if ball_size(near) <= min(len(self.values), MOST_PROBES):
            wanted = mine[:, None] ^ ball(near)[None, :]
            bucket = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
            query, at = np.nonzero(self.values[bucket] == wanted)
            bucket = bucket[query, at]
        else:
            query, bucket = np.nonzero(np.bitwise_count(mine[:, None] ^ self.values[None, :]) <= near)
        size = self.sizes[bucket]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        row = self.rows[np.repeat(self.starts[bucket] - ends + size, size) + np.arange(total)]
        query = np.repeat(query, size)
        for earlier in range(self.substring):
            new = np.bitwise_count(codes[query, earlier] ^ self.codes[row, earlier]) > near
            query, row = query[new], row[new]
        within = distances(codes[query], self.codes[row]) <= radius
        return query[within], row[within]


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    sorted_query = query[order]
    first = np.searchsorted(sorted_query, sorted_query)
    return order[np.arange(len(order)) - first < k]


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector as array<double>) of the rows that take part."""
    v = F.col("vector")
    out = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(v.isNotNull() & (F.size(v) > 0))
    return out.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def coded(classes: DataFrame, coder: Coder, shards: int, kind: str) -> DataFrame:
    """classes (class_id, vector) with the vector as bytes of its own number type, its code, and the shard of each substring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(coder.mean)))
            codes = coder.codes(vectors)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * SUBSTRINGS, pa.int32()), pa.array(shard_of(codes, shards).ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), *(pa.array([x.tobytes() for x in part], pa.binary()) for part in (vectors.astype(kind), codes)), lists], names=["class_id", "vector", "code", "shards"])

    return classes.select("class_id", "vector").mapInArrow(run, "class_id long, vector binary, code binary, shards array<int>")


def probe_round(index: DataFrame, asked: DataFrame, radius: int, shards: int, k: int, kind: str, rows_each: int = ROWS_EACH, queries_each: int = QUERIES_EACH) -> DataFrame:
    """(query_class, class_id, score): the k best classes within the radius of each class in asked (class_id, vector, code)."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [probed_shards(np.frombuffer(code, np.uint64), radius, shards) for code in batch.column("code").to_pylist()]
            size = np.fromiter(map(len, places), np.int64, len(places))
            flat = np.array([p for ps in places for p in ps], np.int32).reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(len(places)), size))
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), *(batch.column(c).take(owner) for c in ("class_id", "vector", "code"))], names=["substring", "shard", "class_id", "vector", "code"])

    body = ["class_id", "vector", "code"]
    queries = asked.select(*body).mapInArrow(visits, "substring int, shard int, class_id long, vector binary, code binary")
    used = SUBSTRINGS if radius // SUBSTRINGS < WIDTH else 1
    rows = index.select(F.posexplode(F.slice("shards", 1, used)).alias("substring", "shard"), *body)
    counted = lambda df, name: df.groupBy("substring", "shard").agg(F.count("*").alias(name))
    # A written table has a known size, so that a small one is broadcast and the vectors are shuffled once.
    cells = Written(index.sparkSession)(counted(rows, "n_rows").join(counted(queries, "n_queries"), ["substring", "shard"])
        .select("substring", "shard", F.ceil(F.col("n_rows") / rows_each).cast("int").alias("row_parts"), F.ceil(F.col("n_queries") / queries_each).cast("int").alias("query_parts")))
    part = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = rows.join(cells, ["substring", "shard"]).select("substring", "shard", part("row_parts").alias("row_part"), every("query_parts").alias("query_part"), F.lit(False).alias("asks"), *body)
    queries = queries.join(cells, ["substring", "shard"]).select("substring", "shard", every("row_parts").alias("row_part"), part("query_parts").alias("query_part"), F.lit(True).alias("asks"), *body)

    def matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("class_id")
        ask, rest = table.filter(table.column("asks")), table.filter(pa.compute.invert(table.column("asks")))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(ask) and len(rest):
            buckets = Buckets(matrix(rest.column("code"), "<u8"), table.column("substring")[0].as_py())
            vectors, ids = matrix(rest.column("vector"), kind), rest.column("class_id").to_numpy()
            ask_codes, ask_vectors, ask_ids = matrix(ask.column("code"), "<u8"), matrix(ask.column("vector"), kind), ask.column("class_id").to_numpy()
            for lo in range(0, len(ask), AT_ONCE):
                query, row = buckets.probe(ask_codes[lo : lo + AT_ONCE], radius)
                for a, b in _steps(query):
                    q, r = query[a:b], row[a:b]
                    score = (ask_vectors[lo + q].astype(np.float64) * vectors[r]).sum(axis=1)
                    keep = best_of(q, ids[r], score, k)
                    out.append((ask_ids[lo + q[keep]], ids[r[keep]], score[keep]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table(dict(zip(("query_class", "class_id", "score"), columns, strict=True)))

    best = rows.unionByName(queries).groupBy("substring", "shard", "row_part", "query_part").applyInArrow(run, "query_class long, class_id long, score double")
    order = W.partitionBy("query_class").orderBy(F.col("score").desc(), "class_id")
    return best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def _steps(query: np.ndarray, pairs: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of whole queries with about so many pairs; query is sorted by probe() only where buckets are scanned, so equal queries may fall apart, which costs no result."""
    for lo in range(0, len(query), pairs):
        yield lo, min(lo + pairs, len(query))


def search(rows: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", sample_rows: int = SAMPLE_ROWS, rows_each: int = ROWS_EACH, queries_each: int = QUERIES_EACH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that is_query (a Column on vec_id) picks."""
    clean = cut(usable(rows, vector).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(sample):
        return empty
    dimensions = int(sample.vector.map(len).mode().iloc[0])
    clean = clean.where(F.size("vector") == dimensions)
    points, total = np.stack(sample.vector[sample.vector.map(len) == dimensions].to_list()), clean.count()
    coder = learn(points, k, len(points) / total)
    by_id = W.partitionBy("vector").orderBy("vec_id")
    members = cut(clean.select("vector", "vec_id", F.row_number().over(by_id).alias("nth")).where(F.col("nth") <= k + 1).withColumn("class_id", F.first("vec_id").over(by_id)))
    classes = members.where("nth = 1").select("class_id", "vector")
    shards = max(1, math.ceil(classes.count() / rows_each))
    kind = "<f4" if rows.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    index = cut(coded(classes, coder, shards, kind))
    asking = cut(clean.where(is_query).join(classes, "vector").select(F.col("vec_id").alias("query_id"), "class_id"))
    asked = index.join(asking.select("class_id").distinct(), "class_id", "left_semi")
    found = cut(probe_round(index, asked, coder.radius, shards, k + 1, kind, rows_each, queries_each))
    members = members.select("class_id", "vec_id")
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n"))
    reached = found.join(sizes, "class_id").groupBy("query_class").agg(F.sum("n").alias("n"))
    short = cut(asked.join(reached.where(F.col("n") >= min(k + 1, total)), F.col("class_id") == F.col("query_class"), "left_anti"))
    if not short.isEmpty():
        again = probe_round(index, short, BITS, shards, k + 1, kind, rows_each, queries_each)
        found = found.join(short.select(F.col("class_id").alias("query_class")), "query_class", "left_anti").union(again)
    pairs = asking.withColumnRenamed("class_id", "query_class").join(found, "query_class").join(members, "class_id").where("vec_id != query_id")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_hashing": op10_hashing}
ORACLES: dict[str, str] = {}

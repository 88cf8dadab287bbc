"""Exact token-count histogram: documents by encoded length, and what every context limit keeps of them.

Texts are encoded where they are and only lengths are shuffled, added up before the shuffle. Sums over all longer
lengths then answer, for any limit, how many documents and tokens it keeps, cuts or drops.

Rows: one for each distinct length and each asked limit. A null or empty text has length 0. Repeated rows count each.
An empty table gives the asked limits only, with counts 0 and a null share. Only the text column is read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, cut, null_safe_text

LIMITS = tuple(1 << k for k in range(7, 18))
#: Lengths of one block of the suffix sums.
BLOCK = 1024


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("lengths", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """``length`` of each row's text in tokens; special tokens' strings are ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks_path).encode_ordinary
        for batch in batches:
            for part, _, _ in chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) for t in part.column(0).to_pylist()], pa.int64())], names=["length"])

    return docs.select(null_safe_text(text).alias("text")).mapInArrow(run, "length long")


def histogram(token_lengths: DataFrame) -> DataFrame:
    """(length, docs), computed once: what follows asks for it several times."""
    return cut(token_lengths.groupBy("length").agg(F.count("*").alias("docs")))


def answers(counts: DataFrame, limits: Sequence[int] = ()) -> DataFrame:
    """For each length of counts (length, docs) and each limit: totals of what is shorter, as long or longer.

    Suffix sums run inside blocks of lengths and over the blocks' sums, so no task holds all lengths.
    """
    asked = counts.sparkSession.createDataFrame([(int(x), 0) for x in limits], "length long, docs long")
    rows = counts.union(asked).groupBy("length").agg(F.sum("docs").alias("docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum(F.col("docs") * F.col("length")).alias("block_tokens"))
    after = W.orderBy("block").rowsBetween(1, W.unboundedFollowing)
    whole = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select("block", zero(F.sum("block_docs").over(after)).alias("later_docs"), zero(F.sum("block_tokens").over(after)).alias("later_tokens"), F.sum("block_docs").over(whole).alias("all_docs"), F.sum("block_tokens").over(whole).alias("all_tokens"))
    onward = W.partitionBy("block").orderBy("length").rowsBetween(W.currentRow, W.unboundedFollowing)
    out = rows.join(blocks, "block").select(
        "length", "docs", "all_docs", "all_tokens",
        (F.sum("docs").over(onward) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum(F.col("docs") * F.col("length")).over(onward) + F.col("later_tokens")).alias("tokens_at_least"),
    )
    return out.select(
        F.col("length").alias("context"),
        "docs",
        (F.col("all_docs") - F.col("docs_at_least") + F.col("docs")).alias("docs_within"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("docs") * F.col("length")).alias("tokens_within"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("length")).alias("tokens_truncated"),
        F.try_divide(F.col("all_docs") - F.col("docs_at_least") + F.col("docs"), F.col("all_docs")).alias("share_within"),
        "all_docs",
        "all_tokens",
    )


def quantiles(answered: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the least length within which at least this share of the documents is."""
    found = [answered.where((F.col("share_within") >= q) & (F.col("docs") > 0)).agg(F.lit(float(q)).alias("share"), F.min("context").alias("length")) for q in shares]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def op9_tokens(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return answers(histogram(lengths(docs, ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))), LIMITS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_tokens": op9_tokens}
ORACLES: dict[str, str] = {}

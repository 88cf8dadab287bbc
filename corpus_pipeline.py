"""The corpus pipeline: stages that each call one operator, in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm import op1_secrets, op3_mixing, op4_sentencepiece, op5_quality, op8_jaccard
from cairnwork.llm.common import Written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled rows among docs.

    Null and empty texts are judged by their statistics alone; repeated rows share their fate; a null doc_id is kept or rejected like another.
    """
    model = op5_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op5_quality.score(docs, model, keep=COLUMNS).where(F.col("score") >= op5_quality.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id (null first, then the first by text) stays.

    Documents without words are no duplicates of anything, so all of them stay; a null text is empty from here on.
    """
    return op8_jaccard.first_of_each(docs.select(*COLUMNS))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the secret scan reports gives way to a mark; n_chars follows the new text. All rows stay, empty ones as they are."""
    return op1_secrets.redact(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order. Documents without words are never taken; a null source is one of the sources."""
    return op3_mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of digests for each row: ids and their decoded text. A null text counts as empty; repeated rows give equal results."""
    encoded = op4_sentencepiece.encode_decode(docs.select("doc_id", "text"), op4_sentencepiece.default_model_path())
    return op4_sentencepiece.digest(encoded)


STAGES: list[tuple[str, Stage]] = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("secrets", drop_secrets), ("mixing", mix_sources), ("sentencepiece", tokenise)]

#: Scores and tokens have no SQL form; tests hold the whole run against plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage but the last is written as Parquet in the shared folder and read again as the next one's docs; the table before it is removed."""
    written = Written(spark, keep=1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"{k}_{name}")
    return docs

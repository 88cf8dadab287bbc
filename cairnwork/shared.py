"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session, whose executors are this machine, may go without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cairnwork-"))
    return sc.getCheckpointDir()


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


class Written:
    """Tables of a loop in the shared folder: each round reads what the round before wrote.

    A table read again carries neither lineage nor constraints, and its size is known. With keep, older tables go. With
    clean, what was shuffled for a table goes once it is written, not when the driver next collects garbage.
    """

    def __init__(self, spark: SparkSession, keep: int | None = None, clean: bool = False):
        self.spark, self.keep, self.clean, self.paths = spark, keep, clean, []
        self.folder = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str | None = None) -> DataFrame:
        path = f"{self.folder}/{name or len(self.paths)}"
        with _cleaned(self.spark) if self.clean else nullcontext():
            df.write.parquet(path)
        self.paths.append(path)
        if self.keep is not None:
            for old in self.paths[: -self.keep]:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(old)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self, like: DataFrame) -> DataFrame:
        """The rows of every table that was written."""
        return self.spark.read.schema(like.schema).parquet(*self.paths)

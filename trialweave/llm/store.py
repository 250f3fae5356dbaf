"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trialweave-llm-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only local sessions without it get a temporary folder."""
    return f"{_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later readers see one and the same run.

    ``batch_rows`` bounds the Arrow batches of this job, for rows that hold texts or long arrays.
    """
    return _write(df, shared_folder(df.sparkSession, name), batch_rows)


def _write(df: DataFrame, path: str, batch_rows: int | None) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_BATCH)
    if batch_rows:
        spark.conf.set(_BATCH, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that only the steps inside need: leaving the block removes their files.

    Whatever is used afterwards has to be stored elsewhere before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark, "scratch")

    def stored(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        return _write(df, f"{self.folder}/{name}-{uuid.uuid4().hex}", batch_rows)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

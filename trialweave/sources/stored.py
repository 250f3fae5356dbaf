"""Samples kept as bucketed tables: joins and sums by run of samples without an exchange.

A table is bucketed and sorted by (subject, chunk). Everything that meets samples by their place in a recording
(cutting epochs, averages over the channels of a run) uses these two columns, so the samples stay where they are and only
the other side moves. The chunk number is part of the bucket, so a long recording spreads over all buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKET_KEYS = ("subject", "chunk")
COLUMNS = ("subject", "channel", "chunk", "start_sample", "values")


def write_samples(chunks: DataFrame, name: str, buckets: int, path: str | None = None, mode: str = "errorifexists") -> None:
    """Store chunked samples (output of ``to_chunks``) as the table ``name``.

    One shuffle puts every run into its bucket, so a bucket is one file; choose ``buckets`` so that it holds 100-200 MB
    and is at least ``spark.sql.shuffle.partitions``: with fewer, Spark may rather shuffle the samples after all.
    """
    missing = [c for c in COLUMNS if c not in chunks.columns]
    if missing:
        raise ValueError(f"samples want the columns {', '.join(missing)}")
    if buckets < 1:
        raise ValueError("at least one bucket")
    placed = chunks.repartition(buckets, *[F.col(c) for c in BUCKET_KEYS])
    writer = placed.write.format("parquet").mode(mode).bucketBy(buckets, *BUCKET_KEYS).sortBy(*BUCKET_KEYS)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def read_samples(spark: SparkSession, name: str) -> DataFrame:
    """The samples of a stored table; refused if it is not bucketed by (subject, chunk)."""
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    columns = described.get("Bucket Columns", "").replace("`", "").replace(" ", "").strip("[]")
    if columns != ",".join(BUCKET_KEYS):
        raise ValueError(f"{name} is not bucketed by {', '.join(BUCKET_KEYS)}")
    return spark.table(name)

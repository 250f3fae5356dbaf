"""Text tables: scans with fixed schemas, sinks, and catalogs of stored files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import snake_to_camel

ALIGNMENT_SCHEMA = "onset double, offset double, label string"
EVENTS_SCHEMA = (
    "subject string, trial int, onset double, duration double, value string, trial_type string, sample bigint"
)
CHANMAP_SCHEMA = "row int, col int, channel_number int, name string, electrode_type string"

# column descriptions written into the schema of event tables
EVENT_UNITS = {"onset": "s", "duration": "s"}


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """Alignment text without header, with the file each row came from."""
    rows = spark.read.csv(path, sep="\t", schema=ALIGNMENT_SCHEMA)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated table with a header line."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="n/a")


def describe_events(events: DataFrame) -> DataFrame:
    """Attach descriptions and units as column metadata."""
    for name, unit in EVENT_UNITS.items():
        if name in events.columns:
            events = events.withColumn(name, F.col(name).alias(name, metadata={"units": unit}))
    return events


def write_derivative(
    df: DataFrame, path: str, file_type: str = "parquet", overwrite: bool = False,
    partition_by: Sequence[str] = (),
) -> None:
    """Write a derivative table; an existing one is kept unless ``overwrite``."""
    writer = df.write.mode("overwrite" if overwrite else "ignore")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if file_type == "parquet":
        writer.parquet(path)
    elif file_type == "tsv":
        writer.csv(path, sep="\t", header=True, nullValue="n/a")
    else:
        raise ValueError(f"file type must be 'parquet' or 'tsv', got {file_type!r}")


def read_electrodes(spark: SparkSession, path: str) -> DataFrame:
    """Electrode positions from whitespace-separated text."""
    from ..operators.geometry import parse_electrodes

    return parse_electrodes(spark.read.text(path))


def feature_lookup(requests: DataFrame, stored: DataFrame, preference: Sequence[str]) -> DataFrame:
    """Stored file of each requested feature, taken from the first data type that has one.

    ``requests``: subject, period, feature (snake case). ``stored``: subject, period, suffix
    (camel case), datatype, path. Requests without any file stay, with a NULL path.
    """
    rank = F.lit(None).cast("int")
    for i, name in enumerate(preference):
        rank = F.coalesce(rank, F.when(F.col("datatype") == name, F.lit(i)))
    ranked = stored.withColumn("__rank", rank).filter(F.col("__rank").isNotNull())
    best = ranked.groupBy("subject", "period", "suffix").agg(
        F.min(F.struct("__rank", "path", "datatype")).alias("__best")
    )
    wanted = requests.withColumn("suffix", snake_to_camel(F.col("feature")))
    return wanted.join(best, ["subject", "period", "suffix"], "left").select(
        "subject", "period", "feature", "suffix",
        F.col("__best.datatype").alias("datatype"), F.col("__best.path").alias("path"),
    )


def missing_periods(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Requested (subject, period) pairs without a stored result."""
    return requested.join(existing, ["subject", "period"], "left_anti")


def missing_inputs(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected paths that do not exist, all of them in one report."""
    return expected.join(found.select("path").distinct(), "path", "left_anti")


def require_inputs(expected: DataFrame, found: DataFrame) -> None:
    """Fail with every missing path, if there are any."""
    missing = [row.path for row in missing_inputs(expected, found).select("path").orderBy("path").toLocalIterator()]
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))

"""Bindings of the driver tables to the domain tables, as DataFrames and as SQL texts.

No recordings are among the driver tables, so each domain table is a projection of one
of them. The SQL constants give the same projection as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.numeric import seconds_between

SIGNAL_FS = 100.0
CHUNK = 128
TRIAL_SAMPLES = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# events ------------------------------------------------------------------------

EVENTS_SQL = """ev AS (
  SELECT event_id, user_id AS subject, (epoch_us(ts) - 1704067200000000) / 1e6 AS onset, value,
         CASE event_type WHEN 'view' THEN 'stimulus' WHEN 'click' THEN 'response'
                         ELSE event_type END AS trial_type
  FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log: one subject per user, views are stimuli, clicks are responses."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("subject"),
        seconds_between("ts", "2024-01-01 00:00:00").alias("onset"),
        "value",
        F.when(kind == "view", "stimulus").when(kind == "click", "response").otherwise(kind).alias(
            "trial_type"
        ),
    )


PHONEMES_SQL = """ph AS (
  SELECT event_id, subject, onset, onset + value / 1000 AS "offset", trial_type,
         (['AH0','AE','u','iy1','UH','T','a','k','IY2','ae'])[event_id % 10 + 1] AS label
  FROM ev WHERE trial_type IN ('stimulus', 'response'))"""


def phonemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phoneme alignments: one labelled interval per stimulus or response event."""
    symbols = F.array(*[F.lit(x) for x in ["AH0", "AE", "u", "iy1", "UH", "T", "a", "k", "IY2", "ae"]])
    return (
        events(spark, sf_dir)
        .filter(F.col("trial_type").isin("stimulus", "response"))
        .select(
            "event_id", "subject", "onset",
            (F.col("onset") + F.col("value") / 1000).alias("offset"),
            "trial_type",
            F.get(symbols, (F.col("event_id") % 10).cast("int")).alias("label"),
        )
    )


# signals -----------------------------------------------------------------------

SIGNAL_SQL = """sig AS (
  SELECT o_orderkey % 3 AS subject, (o_orderkey // 3) % 8 + 1 AS contact,
         'E' || ((o_orderkey // 3) % 8 + 1) AS channel, o_orderkey // 24 AS sample,
         floor(o_totalprice) AS value
  FROM orders)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous recording in long form: 3 subjects, one shaft E1..E8, sample index by key."""
    key = F.col("o_orderkey")
    contact = F.pmod(F.floor(key / 3), F.lit(8)) + 1
    return table(spark, sf_dir, "orders").select(
        F.pmod(key, F.lit(3)).alias("subject"),
        contact.alias("contact"),
        F.concat(F.lit("E"), contact.cast("string")).alias("channel"),
        F.floor(key / 24).alias("sample"),
        F.floor("o_totalprice").cast("double").alias("value"),
    )


def samples(spark: SparkSession, sf_dir: str, chunk: int = CHUNK) -> DataFrame:
    """The same recording in chunks: one row per subject, channel and run of samples."""
    from .operators.signals import to_chunks

    return to_chunks(signal(spark, sf_dir), ["subject", "channel"], chunk)


DENSE_EPOCHS_SQL = """dep AS (
  SELECT subject, channel, contact, sample // 25 AS trial, sample % 25 AS t, value,
         (sample // 25) % 5 AS label FROM sig)"""


def dense_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of 25 samples cut from the recording: (trial, channel, t) is unique."""
    trial = F.floor(F.col("sample") / TRIAL_SAMPLES)
    return signal(spark, sf_dir).select(
        "subject", "channel", "contact", trial.alias("trial"),
        F.pmod("sample", F.lit(TRIAL_SAMPLES)).alias("t"), "value",
        F.pmod(trial, F.lit(5)).alias("label"),
    )


def epoch_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense epochs in array form: one row per subject, trial and channel."""
    rows = dense_epochs(spark, sf_dir).groupBy("subject", "trial", "channel", "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda s: s["value"]).alias(
            "values"
        )
    )
    return rows


EPOCHS_SQL = """ep AS (
  SELECT 'E' || l_linenumber AS channel, l_suppkey AS trial, l_suppkey % 5 AS label,
         l_partkey % 40 AS t, l_quantity AS value FROM lineitem)"""


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large long-form epochs: channel by line number, trial by supplier, time bin by part."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("E"), F.col("l_linenumber").cast("string")).alias("channel"),
        F.col("l_suppkey").alias("trial"),
        F.pmod("l_suppkey", F.lit(5)).alias("label"),
        F.pmod("l_partkey", F.lit(40)).alias("t"),
        F.col("l_quantity").alias("value"),
    )


# features ----------------------------------------------------------------------

FEATURES_SQL = """feat AS (
  SELECT vec_id AS trial, vec_id % 4 AS subject, label, embedding AS vec FROM embeddings),
fl AS (
  SELECT trial, subject, label, i // 8 AS ch, i % 8 AS t, CAST(vec[i + 1] AS DOUBLE) AS value
  FROM feat, range(64) AS r(i))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors of 8 channels x 8 times; four subjects."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("trial"),
        F.pmod("vec_id", F.lit(4)).alias("subject"),
        "label",
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).select("trial", "subject", "label", F.posexplode("vec").alias("i", "value"))
    return rows.select(
        "trial", "subject", "label", F.floor(F.col("i") / 8).alias("ch"),
        F.pmod("i", F.lit(8)).alias("t"), "value",
    )


# electrode grids ---------------------------------------------------------------

GRID_SQL = """grid AS (
  SELECT c_custkey // 64 AS subject, CAST((c_custkey % 64) // 8 AS INTEGER) AS "row",
         CAST(c_custkey % 8 AS INTEGER) AS col,
         CASE WHEN c_acctbal >= 3000 THEN CAST(c_custkey % 64 AS INTEGER) END AS channel_number,
         c_mktsegment = 'MACHINERY' AS is_macro
  FROM customer)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel maps of 8 x 8 cells, one per 64 customers; NULL channel = empty cell."""
    key = F.col("c_custkey")
    cell = F.pmod(key, F.lit(64))
    return table(spark, sf_dir, "customer").select(
        F.floor(key / 64).alias("subject"),
        F.floor(cell / 8).cast("int").alias("row"),
        F.pmod(key, F.lit(8)).cast("int").alias("col"),
        F.when(F.col("c_acctbal") >= 3000, cell.cast("int")).alias("channel_number"),
        (F.col("c_mktsegment") == "MACHINERY").alias("is_macro"),
    )

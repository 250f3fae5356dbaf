"""SQL table functions against the DataFrame path."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trialweave.operators import epochs as ep, filters as fl, signals as sg, table_functions as tf

FS, CHUNK = 100.0, 16


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(2)
    rows = [(s, c, i, float(rng.normal())) for s in ("a", "b") for c in ("x", "y") for i in range(150 if s == "a" else 70)]
    samples = spark.createDataFrame(rows, "subject string, channel string, sample long, value double")
    return sg.to_chunks(samples, ["subject", "channel"], CHUNK)


@pytest.fixture(scope="module")
def events(spark):
    # equal events, one at the start, some beyond the end, a column that is carried and may be NULL
    rows = [("a", 0, 0.30, "q"), ("a", 1, 0.77, None), ("a", 1, 0.77, None), ("a", 2, 0.05, "r"), ("b", 0, 0.33, "s"), ("b", 1, 0.69, "t"), ("c", 0, 0.3, "u")]
    return spark.createDataFrame(rows, "subject string, trial int, onset double, note string")


def pieces(events, chunks):
    low = F.round(F.col("onset") * FS).cast("long") - 10
    windows = events.withColumn("lo", low).withColumn("hi", low + 31).filter("lo >= 0")
    return tf.window_pieces(windows, chunks, CHUNK)


def as_rows(df):
    return sorted(map(str, ((r.subject, r.trial, r.note, r.channel, r["values"]) for r in df.collect())))


def test_epochs_equal_the_dataframe_path(spark, events, chunks):
    tf.register(spark)
    pieces(events, chunks).createOrReplaceTempView("pieces")
    got = spark.sql("SELECT * FROM epochs(TABLE(pieces))")
    assert got.columns == ["subject", "trial", "onset", "note", "channel", "lo", "values"]
    want = ep.extract_epochs(events, chunks, (-0.1, 0.2), FS, CHUNK)
    rows = as_rows(got)
    assert rows == as_rows(want) and len(rows) == 8


def test_pieces_that_do_not_meet_are_an_error(spark, events, chunks):
    tf.register(spark)
    pieces(events, chunks.filter("NOT (subject = 'a' AND chunk = 2)")).createOrReplaceTempView("torn")
    with pytest.raises(PySparkException, match="do not meet"):
        spark.sql("SELECT * FROM epochs(TABLE(torn))").collect()


def test_spectra_follow_epochs(spark, events, chunks):
    tf.register(spark)
    cut = ep.extract_epochs(events, chunks, (-0.1, 0.2), FS, CHUNK).select("subject", "trial", "channel", "values")
    empty = spark.createDataFrame([("z", 0, "x", None), ("z", 1, "x", [])], cut.schema)
    cut.unionByName(empty).createOrReplaceTempView("cut")
    got = spark.sql("SELECT * FROM spectra(TABLE(cut), 100.0D, array(10.0D, 25.0D))").collect()
    kernel = fl.spectrogram_kernel([10.0, 25.0], FS, [5.0, 12.5], 0)
    want = {}
    for r in cut.collect():
        for f, p in zip((10.0, 25.0), kernel(np.array([r["values"]])).reshape(2, -1)):
            want[r.subject, r.trial, r.channel, f] = p
    assert len(got) == 16
    for r in got:
        np.testing.assert_allclose(r.power, want[r.subject, r.trial, r.channel, r.freq], rtol=1e-9, atol=1e-12)


def test_arguments_are_checked(spark, events):
    tf.register(spark)
    events.createOrReplaceTempView("bare")
    with pytest.raises(PySparkException, match="start_sample"):
        spark.sql("SELECT * FROM epochs(TABLE(bare))").collect()

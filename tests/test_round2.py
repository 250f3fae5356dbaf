"""Cases that once lost rows, shifted samples or never ended."""

from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from test_filters import joined, recording
from trialweave.operators import epochs as ep, filters as fl, geometry as geo, signals as sg, stats as st
from trialweave.plans import join_keys
from trialweave.sources import tables as tb


def test_default_notch_at_the_working_rate():
    h = fl.notch_taps(2000.0, 60.0)
    gain = {f: abs(np.sum(h * np.exp(-2j * np.pi * f / 2000.0 * np.arange(len(h))))) for f in (50, 60, 70, 120, 130)}
    assert gain[60] < 0.05 and gain[120] < 0.05
    assert all(abs(gain[f] - 1) < 0.05 for f in (50, 70, 130))


def test_notch_reaches_over_many_chunks(spark):
    noise = np.random.default_rng(6).normal(size=900)
    h = fl.notch_taps(200.0, 20.0)
    half = len(h) // 2
    assert half > 300
    want = fl.convolve_rows(fl.mirror(noise[None, :], half, half), h)[0]
    got = joined(fl.notch(recording(spark, noise, 50), 200.0, 20.0, chunk=50))
    np.testing.assert_allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("n, chunk", [(65, 32), (33, 32), (200, 2), (301, 7)])
def test_iir_notch_with_short_chunks_and_a_lone_last_sample(spark, n, chunk):
    x = np.random.default_rng(7).normal(size=n)
    b, a = fl.iir_notch_coefficients(500.0, 60.0, 0.5)
    want = x.copy()
    for i in range(2, n):
        want[i] = b[0] * x[i] + b[1] * x[i - 1] + b[2] * x[i - 2] - a[1] * want[i - 1] - a[2] * want[i - 2]
    got = joined(fl.iir_notch(recording(spark, x, chunk), 500.0, 60.0, chunk, 0.5))
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_equal_events_keep_their_epochs(spark):
    chunks = recording(spark, np.arange(100.0), 16).withColumnRenamed("subject", "subject")
    events = spark.createDataFrame([("s", 0.3, "x"), ("s", 0.3, "x"), ("s", 0.5, "y")], "subject string, onset double, kind string")
    out = ep.extract_epochs(events, chunks, (-0.1, 0.1), 100.0, 16).collect()
    assert Counter((r.onset, len(r["values"])) for r in out) == {(0.3, 21): 2, (0.5, 21): 1}


@pytest.mark.parametrize("samples", [[0, 1, 3, 4], [0, 1, 1, 2]])
def test_gaps_and_repeats_in_a_chunk_are_errors(spark, samples):
    rows = spark.createDataFrame([("s", "a", i, 1.0) for i in samples], "subject string, channel string, sample long, value double")
    with pytest.raises(PySparkException, match="missing or repeated"):
        sg.to_chunks(rows, ["subject", "channel"], 8).collect()


def test_gap_between_chunks_is_an_error(spark):
    rows = spark.createDataFrame([("s", "a", i, 1.0) for i in range(40) if i != 15], "subject string, channel string, sample long, value double")
    with pytest.raises(PySparkException, match="do not meet"):
        fl.notch(sg.to_chunks(rows, ["subject", "channel"], 16), 100.0, 20.0, taps=5).collect()


def test_points_without_a_place_have_no_vertex(spark):
    points = spark.createDataFrame(
        [("a", 0, 0.0, 0.0, 0.0), ("b", 0, float("nan"), 0.0, 0.0), ("c", 0, None, 0.0, 0.0), ("d", 0, float("inf"), 0.0, 0.0)],
        "name string, hemi long, x double, y double, z double",
    )
    vertices = spark.createDataFrame([(0, 1, 0.1, 0.0, 0.0), (0, 2, 5.0, 1.0, 2.0), (0, 3, float("nan"), 0.0, 0.0)], "hemi long, vertex long, x double, y double, z double")
    out = {r.name: r.vertex for r in geo.nearest_vertex(points, vertices, ["hemi"], "name").collect()}
    assert out == {"a": 1, "b": None, "c": None, "d": None}


def test_folds_differ_by_one_row_at_most(spark):
    rows = [(i, i % 12) for i in range(60)] + [(100 + i, 99) for i in range(30)]
    folded = st.stratified_folds(spark.createDataFrame(rows, "trial long, label long"), "trial", 20).collect()
    sizes = Counter(r.fold for r in folded)
    assert len(sizes) == 20 and max(sizes.values()) - min(sizes.values()) <= 1
    for label in {r.label for r in folded}:
        own = Counter(r.fold for r in folded if r.label == label)
        assert max(own.values()) - min(own[f] for f in range(20)) <= 1


def test_every_missing_input_is_named(spark):
    expected = spark.createDataFrame([(f"p{i:02d}",) for i in range(30)], "path string")
    with pytest.raises(FileNotFoundError, match="p00.*p29"):
        tb.require_inputs(expected, expected.limit(0))


def test_key_less_join_needs_one_row(spark):
    with pytest.raises(ValueError):
        join_keys(spark.range(3), spark.range(2).withColumnRenamed("id", "other"), [])
    assert join_keys(spark.range(3), spark.range(1).withColumnRenamed("id", "other"), []).count() == 3


def test_fft_convolution():
    x, y = np.arange(7.0), np.array([1.0, -2.0, 3.0])
    np.testing.assert_allclose(fl.convolve_full(x, y), np.convolve(x, y), atol=1e-12)


@pytest.mark.parametrize("lost", [1, 3, 6])
def test_lost_chunks_are_errors_whatever_the_reach(spark, lost):
    rows = spark.createDataFrame([("s", "a", i, float(i % 7)) for i in range(8 * 16)], "subject string, channel string, sample long, value double")
    whole = sg.to_chunks(rows, ["subject", "channel"], 16)
    chunks = whole.filter(F.col("chunk") != lost)
    for run in (
        lambda c: fl.notch(c, 100.0, 20.0, taps=5), lambda c: fl.notch(c, 100.0, 20.0, taps=81, chunk=16),
        lambda c: fl.iir_notch(c, 100.0, 20.0, 16), lambda c: fl.resample_poly(c, 1, 2),
    ):
        assert run(whole).count() == 8 and len(run(whole.filter("chunk > 1")).collect()) == 6  # a cropped recording is whole
        with pytest.raises(PySparkException, match="missing|do not meet"):
            run(chunks).collect()

"""Array kernels: invariants, and chunked filters against whole signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions.numeric import check_band
from trialweave.operators import filters as fl, signals as sg, triggers as tg


def recording(spark, x, chunk):
    rows = [("s", "a", i, float(v)) for i, v in enumerate(x)]
    long = spark.createDataFrame(rows, "subject string, channel string, sample long, value double")
    return sg.to_chunks(long.repartition(4), ["subject", "channel"], chunk)


def joined(df):
    rows = sorted(df.collect(), key=lambda r: r.start_sample)
    return np.concatenate([r["values"] for r in rows])


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(5).normal(size=1000)


def test_notch_equals_whole_signal(spark, noise):
    h = fl.notch_taps(200.0, 20.0, taps=61)
    want = fl.convolve_rows(fl.mirror(noise[None, :], 30, 30), h)[0]
    got = joined(fl.notch(recording(spark, noise, 64), 200.0, 20.0, taps=61))
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_notch_removes_line_only(spark):
    t = np.arange(4000) / 500.0
    h = fl.notch_taps(500.0, 60.0, width=4.0, taps=801)
    for freq, low, high in ((60.0, 0.0, 0.05), (120.0, 0.0, 0.05), (180.0, 0.0, 0.05), (30.0, 0.97, 1.03), (90.0, 0.97, 1.03)):
        y = fl.convolve_rows(np.sin(2 * np.pi * freq * t)[None, :], h)[0]
        assert low <= np.abs(y).max() <= high, freq


def test_iir_notch_equals_recursion(spark, noise):
    b, a = fl.iir_notch_coefficients(500.0, 60.0)
    want = noise.copy()
    for i in range(2, len(noise)):
        want[i] = b[0] * noise[i] + b[1] * noise[i - 1] + b[2] * noise[i - 2] - a[1] * want[i - 1] - a[2] * want[i - 2]
    got = joined(fl.iir_notch(recording(spark, noise, 32), 500.0, 60.0, 32))
    np.testing.assert_allclose(got, want, atol=1e-10)
    same = recording(spark, noise, 32)
    assert fl.iir_notch(same, 500.0, 60.0, 32, major_version=3) is same


@pytest.mark.parametrize("up, down", [(2, 5), (3, 2), (1, 4)])
def test_resample_poly_equals_whole_signal(spark, noise, up, down):
    whole = joined(fl.resample_poly(recording(spark, noise, 10_000), up, down))
    parts = joined(fl.resample_poly(recording(spark, noise, 128), up, down))
    assert len(parts) == -(-len(noise) * up // down)
    np.testing.assert_allclose(parts, whole, atol=1e-9)


def test_resample_poly_keeps_a_slow_sine(spark):
    x = np.sin(2 * np.pi * 2.0 * np.arange(2000) / 200.0)
    y = joined(fl.resample_poly(recording(spark, x, 256), 1, 2))
    want = np.sin(2 * np.pi * 2.0 * np.arange(1000) / 100.0)
    np.testing.assert_allclose(y[50:-50], want[50:-50], atol=5e-3)


def test_fft_resample_of_a_sine():
    t = np.arange(200) / 200.0
    y = fl.fft_resample_kernel(200.0, 50.0)(np.sin(2 * np.pi * 5 * t)[None, :])[0]
    np.testing.assert_allclose(y, np.sin(2 * np.pi * 5 * np.arange(50) / 50.0), atol=1e-9)
    back = fl.fft_resample_kernel(50.0, 200.0)(y[None, :])[0]
    np.testing.assert_allclose(back, np.sin(2 * np.pi * 5 * t), atol=1e-9)


def test_band_gain():
    t = np.arange(2000) / 1000.0
    run = fl.band_kernel(70.0, 150.0, 1000.0)
    inside = run(np.sin(2 * np.pi * 100 * t)[None, :])[0][200:-200]
    outside = run(np.sin(2 * np.pi * 20 * t)[None, :])[0][200:-200]
    assert 0.95 < np.abs(inside).max() < 1.05 and np.abs(outside).max() < 0.02


def test_envelope_of_amplitude_modulation():
    t = np.arange(2000) / 1000.0
    shape = 1.0 + 0.5 * np.sin(2 * np.pi * 3 * t)
    y = fl.envelope_kernel(70.0, 150.0, 1000.0)((shape * np.sin(2 * np.pi * 110 * t))[None, :])[0]
    np.testing.assert_allclose(y[200:-200], shape[200:-200], atol=0.02)


def test_smoothing_is_linear_and_keeps_constants(spark):
    run = fl.smooth_kernel(3.0)
    x, y = np.random.default_rng(0).normal(size=(2, 1, 80))
    np.testing.assert_allclose(run(2 * x + y), 2 * run(x) + run(y))
    np.testing.assert_allclose(run(np.ones((1, 20))), 1.0)
    df = spark.createDataFrame([(1, [1.0] * 20), (2, None)], "i int, values array<double>")
    got = {r.i: r.v for r in df.select("i", fl.smooth(F.col("values"), 2.0).alias("v")).collect()}
    np.testing.assert_allclose(got[1], 1.0)
    assert got[2] is None


def test_tapers_are_orthonormal():
    tapers = fl.slepian_tapers(64, 2.0, 3)
    np.testing.assert_allclose(tapers @ tapers.T, np.eye(3), atol=1e-10)


@pytest.mark.parametrize("n", [3, 4, 51, 400])
def test_tapers_equal_the_dense_solution(n):
    i, count = np.arange(n), min(3, n - 1)
    diagonal, off = ((n - 1 - 2 * i) / 2.0) ** 2 * np.cos(4 * np.pi / n), i[1:] * (n - i[1:]) / 2.0
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    got, rows = fl.largest_eigen(diagonal, off, count)
    np.testing.assert_allclose(got, values[::-1][:count], rtol=1e-12, atol=1e-12 * np.abs(values).max())
    np.testing.assert_allclose(np.abs(rows @ vectors[:, ::-1][:, :count]), np.eye(count), atol=1e-10)


def test_long_tapers_are_orthonormal():
    tapers = fl.slepian_tapers(4000, 2.0, 3)
    np.testing.assert_allclose(tapers @ tapers.T, np.eye(3), atol=1e-9)
    assert fl.slepian_tapers(4000, 2.0, 3) is tapers


def test_equal_eigenvalues_have_orthonormal_vectors():
    values, rows = fl.largest_eigen(np.array([2.0, 2.0, 1.0, 2.0]), np.zeros(3), 3)
    np.testing.assert_allclose(values, 2.0)
    np.testing.assert_allclose(rows @ rows.T, np.eye(3), atol=1e-10)


def test_spectrogram_peaks_at_the_frequency(spark):
    t = np.arange(400) / 200.0
    rows = [("s", "a", (np.sin(2 * np.pi * 30 * t + p)).tolist()) for p in (0.0, 1.0)]
    base = [("s", "a", np.random.default_rng(1).normal(size=400).tolist())]
    schema = "subject string, channel string, values array<double>"
    out = fl.spectrogram(spark.createDataFrame(rows, schema), spark.createDataFrame(base, schema), 200.0, range(10, 60, 5))
    powers = out.filter("t between 100 and 300").groupBy("freq").agg(F.avg("power").alias("p")).toPandas()
    assert powers.sort_values("p").freq.iloc[-1] == 30.0


def test_band_arguments(spark):
    assert check_band(300, 1000, 2000) == (300, 999.99)
    for band in ((5, 5), (0, 5)):
        with pytest.raises(ValueError):
            check_band(*band, 100)
    with pytest.raises(ValueError):
        fl.extract_band(None, 100.0, (5, 10), "cube")


# --- triggers ---------------------------------------------------------------------


def trace(spark, x):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "subject string, sample long, value double")


def greedy(at, height, distance):
    keep = np.ones(len(at), dtype=bool)
    for i in sorted(range(len(at)), key=lambda j: (height[j], at[j]), reverse=True):
        if keep[i]:
            for j in range(len(at)):
                if j != i and abs(at[j] - at[i]) < distance:
                    keep[j] = False
    return sorted(np.asarray(at)[keep].tolist())


def test_distance_rule_equals_greedy(spark):
    rng = np.random.default_rng(2)
    at = np.sort(rng.choice(2000, 250, replace=False))
    height = rng.integers(0, 30, 250).astype(float)
    rows = [("s", int(a), float(h)) for a, h in zip(at, height)]
    peaks = spark.createDataFrame(rows, "subject string, sample long, height double")
    for distance in (7, 40):
        got = sorted(r["sample"] for r in tg.keep_distant(peaks, ["subject"], distance).collect())
        assert got == greedy(at, height, distance)


def test_plateau_counts_once(spark):
    x = [0, 1, 5, 5, 5, 1, 0, 2, 4, 4, 6, 0, 3, 3]
    level = spark.createDataFrame([("s", 0.0, 2.0)], "subject string, baseline double, threshold double")
    got = sorted(r["sample"] for r in tg.local_maxima(trace(spark, x), ["subject"], level).collect())
    assert got == [3, 10]


def test_trigger_onsets(spark):
    rng = np.random.default_rng(4)
    x = rng.random(6000) * 0.1
    x[300:400] += 8.0  # task start, one second wide
    x[1200:1320] += 6.0  # restarted
    want = [1800, 2300, 2800, 4000, 5000]
    for k in want:
        x[k - 2 : k + 3] += [2, 4, 10, 4, 2]
    got = sorted(r.onset for r in tg.trigger_onsets(trace(spark, x), ["subject"], 100.0).collect())
    assert got == [k / 100.0 for k in want]

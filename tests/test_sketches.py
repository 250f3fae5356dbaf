"""Long vectors: sketches against plain SVD."""

import numpy as np
from pyspark.sql import functions as F

from trialweave.operators import decoding as dc, sketches as sk
from test_learning import features


def frame(spark, x, parts=6):
    rows = [(i % 2, i, v.tolist()) for i, v in enumerate(x)] + [(0, -1, None)]
    return spark.createDataFrame(rows, "subject int, trial long, vec array<double>").repartition(parts)


def svd(x, k):
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return s[:k] ** 2 / (len(x) - 1), s[:k] ** 2 / (s**2).sum(), vt[:k]


def test_exact_where_rows_are_few(spark):
    x = np.random.default_rng(1).normal(size=(60, 400)) + 5
    for r in sk.fit_pca(frame(spark, x), ["subject"], "trial", 0.8).collect():
        own = x[r.subject :: 2]
        eigen, ratio, vt = svd(own, len(r.eigen))
        np.testing.assert_allclose(r.eigen, eigen, rtol=1e-8)
        np.testing.assert_allclose(r.ratio, ratio, rtol=1e-8)
        assert sum(r.ratio) > 0.8 >= sum(r.ratio[:-1]) and r.n == 30
        np.testing.assert_allclose(r["mean"], own.mean(axis=0), atol=1e-9)
        np.testing.assert_allclose(np.abs(np.reshape(r.comps, (len(eigen), -1)) @ vt.T), np.eye(len(eigen)), atol=1e-6)


def test_same_as_the_gram_way_at_small_length(spark):
    df = features(spark, subjects=1)
    a, b = dc.fit_pca(df, ["subject"], 0.8).first(), sk.fit_pca(df, ["subject"], "trial", 0.8).first()
    for name in ("mean", "comps", "eigen", "ratio"):
        np.testing.assert_allclose(a[name], b[name], atol=1e-8)


def test_leading_axes_where_rows_are_many(spark):
    """More rows than ``rank``: passes of subspace iteration find the axes above the noise."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5)) * [50, 40, 30, 20, 10] @ np.linalg.qr(rng.normal(size=(300, 5)))[0].T + rng.normal(size=(600, 300))
    for r in sk.fit_pca(frame(spark, x), ["subject"], "trial", 5, rank=20).collect():
        eigen, ratio, vt = svd(x[r.subject :: 2], 5)
        np.testing.assert_allclose(r.eigen, eigen, rtol=1e-6)
        np.testing.assert_allclose(r.ratio, ratio, rtol=1e-6)  # shares of the whole variance, not of the basis
        np.testing.assert_allclose(np.abs(np.reshape(r.comps, (5, -1)) @ vt.T), np.eye(5), atol=1e-3)


def test_compression_keeps_distances(spark):
    x = np.random.default_rng(6).normal(size=(40, 2000))
    df = frame(spark, x)
    out = sk.compress(df, sk.basis(df, ["subject"], "trial"), ["subject"], "trial").collect()
    assert len(out) == 40
    for s in (0, 1):
        z = np.array([r.vec for r in sorted((r for r in out if r.subject == s), key=lambda r: r.trial)])
        assert z.shape[1] <= 21
        np.testing.assert_allclose(z @ z.T, x[s::2] @ x[s::2].T, rtol=1e-6, atol=1e-6)


def test_repeated_and_zero_rows(spark):
    x = np.repeat(np.random.default_rng(7).normal(size=(3, 50)), 8, axis=0)
    x[5] = 0
    for r in sk.fit_pca(frame(spark, x), ["subject"], "trial", 1).collect():
        np.testing.assert_allclose(r.eigen, svd(x[r.subject :: 2], 1)[0], rtol=1e-8)
    zero = sk.fit_pca(frame(spark, np.zeros((6, 9))), ["subject"], "trial", 0.8).collect()
    assert len(zero) == 2 and all(r.eigen == [0.0] for r in zero)


def test_decoding_long_vectors(spark):
    """Classes that differ in a few of 25 600 values; folds are totals without a fold, of short vectors."""
    rng = np.random.default_rng(9)
    centres = np.zeros((3, 25_600))
    centres[:, :400] = rng.normal(size=(3, 400)) * 2
    rows = [(0, i, i % 3, (centres[i % 3] + 0.5 * rng.normal(size=25_600)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "subject int, trial long, label int, vec array<double>").repartition(6)
    out = dc.decode_within(df, k=3, n_iter=2, size=64, rank=128)
    assert out.count() == 120 and min(r.score for r in dc.decode_scores(out).collect()) > 0.9


def test_short_and_long_way_agree(spark):
    df = features(spark, gap=1.0)
    plain = dc.decode_within(df, k=4, n_iter=1, size=256).withColumnRenamed("y_pred", "p")
    long = dc.decode_within(df, k=4, n_iter=1, size=256, rank=64)
    both = plain.join(long, ["target", "iter", "trial"])
    assert both.count() == 240 and both.filter(F.col("p") == F.col("y_pred")).count() > 225

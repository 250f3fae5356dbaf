"""Decoding and alignment on data with known structure."""

import numpy as np
import pytest

from trialweave.operators import alignment as al, decoding as dc, stats as st


def features(spark, n=240, d=12, classes=4, subjects=2, gap=3.0, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, d)) * gap
    rows = []
    for i in range(n):
        label = int(rng.integers(classes))
        rows.append((i % subjects, i, label, (centres[label] + rng.normal(size=d)).tolist()))
    return spark.createDataFrame(rows, "subject int, trial long, label int, vec array<double>")


def test_pca_against_svd(spark):
    df = features(spark, subjects=1)
    x = np.array([r.vec for r in df.collect()])
    model = dc.fit_pca(df, ["subject"], 0.8).first()
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    ratio = s**2 / (s**2).sum()
    k = int(np.searchsorted(np.cumsum(ratio), 0.8, side="right")) + 1
    assert len(model.eigen) == k
    np.testing.assert_allclose(model.ratio, ratio[:k])
    axes = np.reshape(model.comps, (k, -1))
    np.testing.assert_allclose(np.abs(axes @ vt[:k].T), np.eye(k), atol=1e-8)


def test_project_keeps_rows_in_small_blocks(spark):
    df = features(spark)
    models = dc.fit_pca(df, ["subject"], 3)
    out = dc.project(df, models, ["subject"], "trial", ["label"])
    assert out.count() == 240 and len(out.first().vec) == 3


def test_separable_classes_decode(spark):
    scores = dc.decode_scores(dc.decode_within(features(spark), k=4, n_iter=2, size=64)).collect()
    assert len(scores) == 4 and min(r.score for r in scores) > 0.9


def test_chance_decoding_is_near_chance(spark):
    out = dc.decode_within(features(spark), k=4, n_iter=2, size=64, chance=True)
    assert out.count() == 480
    assert 0.05 < np.mean([r.score for r in dc.decode_scores(out).collect()]) < 0.5


def test_every_row_is_predicted_once_per_iteration(spark):
    out = dc.decode_within(features(spark), k=4, n_iter=3, size=16)
    assert out.select("iter", "trial").distinct().count() == out.count() == 720


def test_folds_fall_back_without_classes(spark):
    rows = [(0, i, i % 7) for i in range(14)]  # two rows per class, three folds
    df = spark.createDataFrame(rows, "subject int, trial long, label int")
    folds = [r.fold for r in st.stratified_folds(df, "trial", 3, keys=["subject"]).collect()]
    assert sorted(folds.count(f) for f in range(3)) == [4, 5, 5]


def test_linear_decoder(spark):
    rows = st.stratified_folds(features(spark, subjects=1).drop("subject"), "trial", 4)
    out = dc.decode_linear(rows, 0, max_iter=5)
    assert out.filter("y = y_pred").count() / out.count() > 0.8


def test_cca_finds_an_invertible_map(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(80, 4))
    m = rng.normal(size=(4, 4))
    rows = [(0, x.tolist(), (x @ m + 1.0).tolist()) for x in a]
    pairs = spark.createDataFrame(rows, "subject int, vec_a array<double>, vec_b array<double>")
    model = al.fit_cca(pairs, ["subject"])
    np.testing.assert_allclose(model.first().corr, 1.0, atol=1e-9)
    back = al.cca_matrix(model, "b_to_a").first()
    np.testing.assert_allclose(m @ np.reshape(back.matrix, (back.rows, -1)), np.eye(4), atol=1e-8)
    with pytest.raises(ValueError):
        al.cca_matrix(model, "elsewhere")


def test_cca_equals_qr_form():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(60, 3)), rng.normal(size=(60, 5))
    b[:, :2] += a[:, :2]
    joint = np.hstack([a, b])
    m_a, m_b, corr = al.canonical_directions(60, joint.sum(axis=0), (joint.T @ joint).ravel(), 3)
    q_a, _ = np.linalg.qr(a - a.mean(axis=0))
    q_b, _ = np.linalg.qr(b - b.mean(axis=0))
    np.testing.assert_allclose(corr, np.linalg.svd(q_a.T @ q_b)[1], atol=1e-10)
    assert m_a.shape == (3, 3) and m_b.shape == (5, 3)


def subjects_with_shared_dynamics(spark, n=90, channels=6, steps=5, classes=3, noise=0.4):
    rng = np.random.default_rng(11)
    latent = rng.normal(size=(classes, steps, 3)) * 2
    rows = []
    for subject in range(3):
        own = channels + subject  # subjects differ in their channels
        mix = rng.normal(size=(3, own))
        for i in range(n if subject else n // 2):
            label = i % classes
            x = latent[label] @ mix + rng.normal(size=(steps, own)) * noise
            rows.append((subject, subject * 1000 + i, label, x.ravel().tolist()))
    return spark.createDataFrame(rows, "subject int, trial long, label int, vec array<double>")


def test_sources_alone_decode_the_target(spark):
    """Only aligned sources train; without alignment the axes do not match."""
    rows = subjects_with_shared_dynamics(spark)
    options = dict(k=3, n_iter=1, decode=(-1.0, 1.0), target_trains=False, size=64)
    aligned = al.decode_across(rows, 0, 5, **options)
    score = dc.decode_scores(aligned).first().score
    assert aligned.count() == 45 and score > 0.9
    assert dc.decode_scores(al.decode_across(rows, 0, 5, fit_maps=al.separate_maps, **options)).first().score < score


def test_window_steps():
    assert al.window_steps(5, (-1.0, 1.0), (-0.5, 0.5)) == (1, 4)


def test_permutation_p_values(spark):
    rng = np.random.default_rng(0)
    rows = []
    for channel, shift in (("up", 2.0), ("flat", 0.0), ("down", -2.0)):
        for i in range(30):
            rows.append((channel, 2 * i, True, float(rng.normal() + shift)))
            rows.append((channel, 2 * i + 1, False, float(rng.normal())))
    rows += [("few", 0, True, 1.0), ("few", 1, False, 0.0), ("few", 2, False, 0.0)]
    df = spark.createDataFrame(rows, "channel string, obs long, interest boolean, value double")
    p = {r.channel: r.p for r in st.permutation_test(df, ["channel"], "obs", 99).collect()}
    assert p["up"] == 0.01 and p["few"] == 1.0 and p["down"] > 0.9 and 0.01 < p["flat"] < 1.0

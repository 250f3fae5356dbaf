"""Joint alignment of several subjects on data with a planted latent."""

import numpy as np
import pytest

from trialweave.operators import alignment as al, decoding as dc, multiset as ms
from trialweave.plans.blocks import gram_tiles, whole_gram
from test_learning import subjects_with_shared_dynamics


def planted(spark, subjects=5, n=120, d=3, noise=0.05, seed=2):
    rng = np.random.default_rng(seed)
    latent = rng.normal(size=(n, d))
    rows, sides = [], []
    for s in range(subjects):
        x = latent @ rng.normal(size=(d, 6 + s)) + noise * rng.normal(size=(n, 6 + s)) + s
        sides.append(x)
        rows += [(0, s, i % 4, i // 4, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k int, subject int, label int, t int, vec array<double>"), latent, sides


def test_tiles_are_the_gram_matrix(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(57, 23))
    rows = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)] + [(0, None)], "k int, vec array<double>").repartition(4)
    tiles = gram_tiles(rows, ["k"], "vec", tile=7).toPandas()
    for k in (0, 1):
        z = np.hstack([np.ones((len(x[k::2]), 1)), x[k::2]])
        np.testing.assert_allclose(whole_gram(tiles[tiles.k == k], 24, 7), z.T @ z, atol=1e-9)


@pytest.mark.parametrize("solver", [ms.mcca(3, 0.0), ms.mcca(3, 0.5), ms.joint_axes(3)])
def test_planted_latent_is_recovered_from_every_subject(spark, solver):
    rows, latent, _ = planted(spark)
    maps = ms.fit_sets(rows, ["k"], ["label", "t"], solver)
    out = ms.variates(rows, maps, ["k"]).collect()
    centred = latent - latent.mean(axis=0)
    for s in range(5):
        y = np.array([r.vec for r in sorted((r for r in out if r.subject == s), key=lambda r: r.t * 4 + r.label)])
        fit = y @ np.linalg.lstsq(y, centred, rcond=None)[0]
        assert 1 - ((fit - centred) ** 2).sum() / (centred**2).sum() > 0.98
    # the subjects' variates agree with each other, not only up to a turn
    a, b = (np.array([r.vec for r in sorted((r for r in out if r.subject == s), key=lambda r: r.t * 4 + r.label)]) for s in (0, 4))
    assert min(np.corrcoef(a[:, c], b[:, c])[0, 1] for c in range(3)) > 0.95


def test_two_sets_are_plain_cca(spark):
    rows, _, sides = planted(spark, subjects=2, noise=1.0)
    eigen = ms.fit_sets(rows, ["k"], ["label", "t"], ms.mcca(6, 0.0)).first().eigen
    joint = np.hstack(sides)
    corr = al.canonical_directions(len(joint), joint.sum(axis=0), (joint.T @ joint).ravel(), sides[0].shape[1])[2]
    np.testing.assert_allclose(np.array(eigen) - 1, corr[:6], atol=1e-8)


def test_rows_that_a_set_lacks_do_not_count(spark):
    rows, _, sides = planted(spark, subjects=3)
    fewer = rows.filter("NOT (subject = 1 AND label = 2)")
    some = ms.fit_sets(fewer, ["k"], ["label", "t"], ms.mcca(2, 0.1)).first().eigen
    same = ms.fit_sets(rows.filter("label != 2"), ["k"], ["label", "t"], ms.mcca(2, 0.1)).first().eigen
    np.testing.assert_allclose(some, same, rtol=1e-9)


def test_joint_axes_without_noise_are_the_stacked_svd(spark):
    rows, _, sides = planted(spark, noise=0.0)
    maps = {int(r.set): r for r in ms.fit_sets(rows, ["k"], ["label", "t"], ms.joint_axes(3)).collect()}
    joint = np.hstack([x - x.mean(axis=0) for x in sides])
    u, s, _ = np.linalg.svd(joint, full_matrices=False)
    np.testing.assert_allclose(maps[0].eigen, s[:3] ** 2, rtol=1e-8)
    for k, x in enumerate(sides):
        y = (x - maps[k].mean) @ np.reshape(maps[k].matrix, (x.shape[1], 3))
        np.testing.assert_allclose(np.abs(np.sum(y * (u[:, :3] * s[:3]), axis=0)), s[:3] ** 2, rtol=1e-6)


@pytest.mark.parametrize("options", [
    dict(fit_maps=al.mean_maps(ms.mcca(3, 0.1)), n_comp_align=0.99), dict(fit_maps=al.mean_maps(ms.joint_axes(3)), n_comp_align=0.99),
    dict(joint=ms.joint_axes(3)), dict(joint=ms.mcca(3, 0.3)),
])
@pytest.mark.parametrize("target_trains", [True, False])
def test_joint_maps_decode_the_target(spark, options, target_trains):
    rows = subjects_with_shared_dynamics(spark)
    out = al.decode_across(rows, 0, 5, k=3, n_iter=1, decode=(-1.0, 1.0), target_trains=target_trains, size=64, **options)
    assert out.count() == 45 and dc.decode_scores(out).first().score > 0.9


def test_trial_maps_leave_the_test_fold_out(spark):
    """Maps of a fold are those of a fit without the target's trials in it."""
    rows = subjects_with_shared_dynamics(spark, n=30).withColumnRenamed("label", "align_label")
    folded = dc.fold_table(rows.filter("subject = 0").withColumnRenamed("align_label", "label"), "trial", 3, 1, 42)
    tagged = rows.join(dc._fold_arrays(folded, "trial", ["subject"]), ["subject", "trial"], "left")
    tagged = tagged.withColumn("subject", tagged.subject.cast("string"))
    maps = {(r.subject, r.test_fold): r for r in al.trial_maps(tagged, 0, 3, 5, (0, 5), ms.joint_axes(3)).collect()}
    aligned = ms.aligned_trials(tagged, label="align_label")
    left = {(r.align_label, r.pick) for r in aligned.filter("subject = '0'").collect() if r.folds[0] != 1}
    kept = al.time_rows(aligned.drop("folds"), 5).withColumn("k", aligned.pick * 0)
    kept = [r for r in kept.collect() if (r.align_label, r.pick) in left]
    frame = spark.createDataFrame([(0, r.subject, r.align_label, r.pick, r.t, r.vec) for r in kept], "k int, subject string, l int, p long, t int, vec array<double>")
    for r in ms.fit_sets(frame, ["k"], ["l", "p", "t"], ms.joint_axes(3)).collect():
        np.testing.assert_allclose(maps[r.set, 1].lin_matrix, r.matrix, rtol=1e-6, atol=1e-9)

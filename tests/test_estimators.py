"""Reducers, aligners and decoders of a caller against whole training sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import alignment as al, decoding as dc, estimators as es
from test_learning import features


def folds_by_hand(df, k, n_iter):
    """Training rows, test ids and test rows per subject, iteration and fold."""
    x = {r.trial: (str(r.subject), r.label, np.array(r.vec)) for r in df.collect()}
    fold = {(r.iter, r.trial): r.fold for r in dc.fold_table(df, "trial", k, n_iter).collect()}
    for subject in sorted({s for s, _, _ in x.values()}):
        for i in range(n_iter):
            for f in range(k):
                own = [t for t in x if x[t][0] == subject]
                train = [t for t in own if fold[i, t] != f]
                test = [t for t in own if fold[i, t] == f]
                yield subject, i, np.array([x[t][2] for t in train]), np.array([x[t][1] for t in train]), test, np.array([x[t][2] for t in test])


def predicted(out):
    return {(r.target, r.iter, r.trial): r.y_pred for r in out.collect()}


def callers_nearest_mean():
    """Written as a caller would, with nothing from the library but the two classes."""

    def partial(x, y, classes):
        return np.concatenate([np.concatenate([[(y == c).sum()], x[y == c].sum(axis=0)]) for c in classes])

    def solve(acc, classes):
        rows = acc.reshape(len(classes), -1)
        return rows[:, 1:] / rows[:, :1]

    def predict(x, parameters, classes):
        mean = parameters.reshape(len(classes), -1)
        return classes[((x[:, None] - mean[None]) ** 2).sum(axis=2).argmin(axis=1)]

    return es.Decoder(partial, solve, predict)


def lda_by_hand(x, y, z):
    classes = np.unique(y)
    mean = np.array([x[y == c].mean(axis=0) for c in classes])
    within = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in zip(classes, mean)) / (len(x) - len(classes))
    inverse = np.linalg.pinv(within)
    prior = np.log([np.mean(y == c) for c in classes])
    return classes[(z @ inverse @ mean.T - 0.5 * np.einsum("cd,de,ce->c", mean, inverse, mean) + prior).argmax(axis=1)]


def test_a_callers_nearest_mean_runs_in_blocks(spark):
    df = features(spark, gap=0.7)
    out = dc.decode_within(df, k=4, n_iter=2, reducer="none", classifier=callers_nearest_mean(), rows_per_block=20)
    want = {}
    for s, i, x, y, ids, z in folds_by_hand(df, 4, 2):
        classes = np.unique(y)
        mean = np.array([x[y == c].mean(axis=0) for c in classes])
        want.update({(s, i, t): int(c) for t, c in zip(ids, classes[((z[:, None] - mean) ** 2).sum(axis=2).argmin(axis=1)])})
    assert predicted(out) == want
    registered = dc.decode_within(df, k=4, n_iter=2, reducer="none", classifier="nearest_mean")
    assert predicted(registered) == want


def test_discriminant_decoder_equals_the_closed_form(spark):
    df = features(spark, gap=0.7)
    out = dc.decode_within(df, k=3, n_iter=1, reducer="none", classifier=es.discriminant_decoder(1e-12), rows_per_block=25)
    want = {}
    for s, i, x, y, ids, z in folds_by_hand(df, 3, 1):
        want.update({(s, i, t): int(c) for t, c in zip(ids, lda_by_hand(x, y, z))})
    assert predicted(out) == want


def test_nearest_mean_on_discriminant_axes_is_discriminant_analysis(spark):
    """With equal priors left aside: in the axes that make the scatter within classes round, the nearest mean wins."""
    df = features(spark, n=160, gap=0.8, subjects=1)
    axes = es.discriminant_axes(3, 1e-12)
    out = predicted(dc.decode_within(df, k=2, n_iter=1, reducer=axes, classifier="nearest_mean"))
    for s, i, x, y, ids, z in folds_by_hand(df, 2, 1):
        classes = np.unique(y)
        mean = np.array([x[y == c].mean(axis=0) for c in classes])
        within = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in zip(classes, mean))
        inverse = np.linalg.inv(within)
        gap = z[:, None] - mean[None]
        best = classes[np.einsum("ncd,de,nce->nc", gap, inverse, gap).argmin(axis=1)]
        assert [out[s, i, t] for t in ids] == best.tolist()


@pytest.mark.parametrize("classifier", ["least_squares", "margin"])
def test_kernels_take_a_callers_reducer(spark, classifier):
    out = dc.decode_within(features(spark), k=3, n_iter=1, size=64, reducer="discriminant", classifier=classifier)
    scores = dc.decode_scores(out).collect()
    assert len(scores) == 2 and min(r.score for r in scores) > 0.9


def test_a_merge_that_is_no_sum_meets_in_rounds(spark):
    rows = [(key, [float(i), float(-i)]) for key, n in (("a", 700), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, acc array<double>").repartition(7)
    got = {r.key: r.acc for r in es.merged(df, ["key"], np.maximum).collect()}
    assert got == {"a": [699.0, 0.0], "b": [0.0, 0.0]}
    assert {r.key: r.acc[0] for r in es.merged(df, ["key"], None).collect()} == {"a": 699 * 350.0, "b": 0.0}


def test_names_are_checked_and_registered(spark):
    with pytest.raises(ValueError, match="none of"):
        dc.decode_within(features(spark, n=20), k=2, n_iter=1, classifier="unheard of")
    es.register_decoder("mine", callers_nearest_mean())
    try:
        assert dc.decode_within(features(spark, n=40), k=2, n_iter=1, classifier="mine").count() == 40
    finally:
        del es.DECODERS["mine"]


def test_aligner_and_decoder_by_name_across_subjects(spark):
    df = features(spark, n=120, d=12, subjects=3)
    calls = []

    def mine(*tables):
        calls.append(1)
        return al.separate_maps(*tables)

    al.register_aligner("mine", mine)
    try:
        out = al.decode_across(df, 0, 4, k=3, n_iter=1, fit_maps="mine", classifier="nearest_mean", full=(-1.0, 1.0))
        assert out.count() == 40 and calls == [1]
    finally:
        del al.ALIGNERS["mine"]

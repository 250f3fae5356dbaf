"""The maximum-margin classifier: optimality conditions, a brute-force dual, and the cascade."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import decoding as dc, margin as mg
from test_learning import features


def problem(n=120, d=3, gap=1.0, seed=0):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(n) < 0.4, 1.0, -1.0)
    return rng.normal(size=(n, d)) + gap * y[:, None] * [1, 0, 0], y, np.where(y > 0, 1.5, 0.8)


def brute_force(x, y, cost, gamma, sweeps=4000):
    """The same dual by cyclic two-row steps over all pairs, to convergence."""
    q = mg.rbf(x, x, gamma)
    a, f = np.zeros(len(y)), np.zeros(len(y))  # f = K (a y)
    for _ in range(sweeps):
        moved = 0.0
        for i in range(len(y)):
            j = (i + 1 + np.random.default_rng(int(_ * len(y) + i)).integers(len(y) - 1)) % len(y)
            low, high = (-a[i], cost[i] - a[i]) if y[i] > 0 else (a[i] - cost[i], a[i])
            low_j, high_j = (a[j] - cost[j], a[j]) if y[j] > 0 else (-a[j], cost[j] - a[j])
            step = ((y[i] - f[i]) - (y[j] - f[j])) / max(2 - 2 * q[i, j], 1e-12)
            step = np.clip(step, max(low, low_j), min(high, high_j))
            a[i], a[j] = a[i] + y[i] * step, a[j] - y[j] * step
            f += step * (q[:, i] - q[:, j])
            moved = max(moved, abs(step))
        if moved < 1e-9:
            break
    free = (a > 1e-6) & (a < cost - 1e-6)
    return a, float((y - f)[free].mean())


@pytest.mark.parametrize("gap", [0.2, 1.0, 3.0])
def test_conditions_of_the_optimum(gap):
    x, y, cost = problem(gap=gap)
    a, bias = mg.solve_dual(x, y, cost, 0.5)
    assert abs((a * y).sum()) < 1e-9 and (a >= 0).all() and (a <= cost).all()
    side = y * (mg.rbf(x, x, 0.5) @ (a * y) + bias)
    eps = 2 * mg.TOLERANCE
    assert (side[a == 0] >= 1 - eps).all() and (side[a == cost] <= 1 + eps).all()
    assert np.abs(side[(a > 0) & (a < cost)] - 1).max(initial=0) <= eps
    norm = (a * y) @ mg.rbf(x, x, 0.5) @ (a * y)
    primal, dual = norm / 2 + (cost * np.maximum(1 - side, 0)).sum(), a.sum() - norm / 2
    assert primal - dual < 2e-3 * max(dual, 1)


def test_equals_a_brute_force_dual_on_200_rows():
    x, y, cost = problem(200, gap=0.8, seed=3)
    a, bias = mg.solve_dual(x, y, cost, 0.4, 1e-6)
    other, other_bias = brute_force(x, y, cost, 0.4)
    new = np.random.default_rng(1).normal(size=(500, 3))
    f = mg.rbf(new, x, 0.4) @ (a * y) + bias
    g = mg.rbf(new, x, 0.4) @ (other * y) + other_bias

    def value(w):
        return w.sum() - (w * y) @ mg.rbf(x, x, 0.4) @ (w * y) / 2

    # the plain steps come close from below and are never above the optimum
    assert value(a) >= value(other) > value(a) - 1e-3
    np.testing.assert_allclose(f, g, atol=1e-2)
    assert (np.sign(f) == np.sign(g))[np.abs(g) > 1e-2].all()


def test_one_class_and_repeated_rows():
    assert mg.solve_dual(np.ones((4, 2)), -np.ones(4), np.ones(4), 1.0)[1] == -1.0
    x, y, cost = problem(40)
    a, bias = mg.solve_dual(np.vstack([x, x]), np.append(y, y), np.append(cost, cost), 0.5)
    b, other = mg.solve_dual(x, y, 2 * cost, 0.5)
    assert abs(bias - other) < 5e-3 and np.isfinite(a).all()


def test_kernel_columns_without_room(monkeypatch):
    x, y, cost = problem()
    a, bias = mg.solve_dual(x, y, cost, 0.5)
    monkeypatch.setattr(mg, "KEPT_DOUBLES", 300)
    b, other = mg.solve_dual(x, y, cost, 0.5)
    assert np.array_equal(a, b) and bias == other


def test_decodes_separable_classes(spark):
    scores = dc.decode_scores(dc.decode_within(features(spark), k=4, n_iter=2, classifier="margin")).collect()
    assert len(scores) == 4 and min(r.score for r in scores) > 0.9
    with pytest.raises(ValueError):
        dc.decode_within(features(spark), k=4, n_iter=1, classifier="other")


def test_cascade_of_blocks_gives_the_whole_optimum(spark):
    """Many small blocks against one: equal predictions but where two classes are about level."""
    df = features(spark, n=300, gap=0.7, subjects=1)
    one = dc.decode_within(df, k=3, n_iter=1, classifier="margin").withColumnRenamed("y_pred", "p")
    many = dc.decode_within(df, k=3, n_iter=1, classifier="margin", rows_per_block=25)
    both = one.join(many, ["target", "iter", "trial"])
    assert both.count() == 300 and both.filter(F.col("p") == F.col("y_pred")).count() >= 298


@pytest.mark.parametrize("gap", [0.2, 1.0, 3.0])
def test_some_rows_at_a_time_reach_the_optimum(monkeypatch, gap):
    x, y, cost = problem(300, gap=gap)
    whole, bias = mg.solve_dual(x, y, cost, 0.5)
    monkeypatch.setattr(mg, "WHOLE_ROWS", 100)
    monkeypatch.setattr(mg, "WORKING_ROWS", 16)
    q = mg.rbf(x, x, 0.5)
    for start in (None, whole):
        a, other = mg.solve_dual(x, y, cost, 0.5, start=start)
        assert abs((a * y).sum()) < 1e-9 and (a >= 0).all() and (a <= cost).all()
        np.testing.assert_allclose(q @ (a * y) + other, q @ (whole * y) + bias, atol=5e-3)


def test_kernel_columns_are_computed_many_at_a_time(monkeypatch):
    x, y, cost = problem(640, gap=0.0)
    calls, rbf = [], mg.rbf
    monkeypatch.setattr(mg, "rbf", lambda *a: calls.append(1) or rbf(*a))
    a, _ = mg.solve_dual(x, y, cost, 0.5)
    assert (a > 0).sum() > 320 and len(calls) <= 20


def classes(spark, n=300, k=3, subject="s"):
    rng = np.random.default_rng(6)
    rows = [(subject, i, i % k, (rng.normal(size=5) + 1.5 * np.eye(5)[i % k]).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "subject string, trial long, label int, vec array<double>")


def test_blocks_of_a_pair_are_solved_in_one_round(spark, monkeypatch):
    """Many blocks take no more rounds than one, and a found pair carries places and weights, not rows."""
    df, rounds, found = classes(spark), [], []
    cut, fit = mg.cut_lineage, mg.fit
    monkeypatch.setattr(mg, "cut_lineage", lambda d: rounds.append(1) or cut(d))
    monkeypatch.setattr(mg, "fit", lambda *a: found.append(fit(*a)) or found[-1])
    got = []
    for size in (1000, 20):
        rounds.clear()
        got.append({r.trial: r.y_pred for r in dc.decode_within(df, k=3, n_iter=1, classifier="margin", rows_per_block=size).collect()})
        got.append(len(rounds))
    one, few, many, more = got
    assert few == more and len(one) == 300 and sum(one[t] == many[t] for t in one) >= 297
    assert all("points" not in f.columns for f in found)


@pytest.mark.parametrize("rows", [100, 30])
def test_pairs_of_many_rows_are_solved_in_parts(spark, monkeypatch, rows):
    df, met = classes(spark), []
    whole = {r.trial: r.y_pred for r in dc.decode_within(df, k=3, n_iter=1, classifier="margin").collect()}
    meet = mg._meet_pairs
    monkeypatch.setattr(mg, "_meet_pairs", lambda *a: met.append(1) or meet(*a))
    monkeypatch.setattr(mg, "PAIR_ROWS", rows)
    parts = {r.trial: r.y_pred for r in dc.decode_within(df, k=3, n_iter=1, classifier="margin", rows_per_block=15).collect()}
    assert met and parts.keys() == whole.keys() and sum(parts[t] == whole[t] for t in whole) >= 297


def test_support_vectors_of_several_parts_add_up(spark, monkeypatch):
    df = classes(spark)
    whole = {r.trial: r.y_pred for r in dc.decode_within(df, k=3, n_iter=1, classifier="margin", rows_per_block=20).collect()}
    monkeypatch.setattr(mg, "BLOCKS_PER_TASK", 2)
    parts = {r.trial: r.y_pred for r in dc.decode_within(df, k=3, n_iter=1, classifier="margin", rows_per_block=20).collect()}
    assert len(whole) == 300 and parts == whole


@pytest.mark.parametrize("size", [1000, 30])
def test_all_subjects_of_a_model_train_it(spark, size):
    """Rows of another subject weigh as much as rows of one's own that are never tested."""
    folded = F.when(F.col("trial") < 100, F.array((F.col("trial") % 2).cast("int")))
    rows = classes(spark).withColumn("folds", folded)
    models = spark.range(2).select(
        F.lit("s").alias("target"), F.lit("s").alias("subject"), F.lit(0).alias("iter"), F.col("id").cast("int").alias("test_fold"),
        F.array(*[F.lit(c) for c in range(3)]).alias("classes"), F.lit(True).alias("trains"),
        F.lit(None).cast("array<double>").alias("lin_mean"), F.lit(None).cast("array<double>").alias("lin_matrix"),
        F.lit(None).cast("int").alias("t_first"), F.lit(None).cast("int").alias("t_stop"),
    )
    other = F.when(F.col("trial") >= 100, F.lit("t")).otherwise(F.col("subject"))
    apart = rows.withColumn("subject", other).withColumn("trial", F.when(F.col("trial") < 100, F.col("trial")).otherwise(F.col("trial") - 100))
    both = models.unionByName(models.withColumn("subject", F.lit("t")))
    want, got = (
        {r.trial: r.y_pred for r in dc.decode(r, m, 2, classifier="margin", rows_per_block=size).collect()}
        for r, m in ((rows, models), (apart, both))
    )
    assert len(want) == 100 and want.keys() == got.keys() and sum(want[t] == got[t] for t in want) >= 99

"""Counter-drawn permutations against exact enumeration."""

from itertools import combinations

import numpy as np
import pytest

from trialweave.operators import stats as st


def test_every_observation_is_chosen_equally_often():
    scores = st._scores(np.arange(12, dtype=np.uint64), np.arange(1, 20_001), 42)
    chosen = np.argpartition(scores, 4, axis=1)[:, :5]
    share = np.bincount(chosen.ravel(), minlength=12) / 20_000
    np.testing.assert_allclose(share, 5 / 12, atol=0.02)
    # pairs too: neighbouring counters are not related
    both = (chosen == 0).any(axis=1) & (chosen == 1).any(axis=1)
    assert abs(both.mean() - 5 / 12 * 4 / 11) < 0.02


def test_p_values_near_the_exact_ones(spark):
    rng = np.random.default_rng(3)
    rows, exact = [], {}
    for channel, shift in (("a", 0.0), ("b", 0.8), ("c", 3.0)):
        values = rng.normal(size=10)
        values[:4] += shift
        rows += [(channel, i, i < 4, float(v)) for i, v in enumerate(values)]
        observed = values[:4].mean() - values[4:].mean()
        every = [values[list(c)].mean() - np.delete(values, list(c)).mean() for c in combinations(range(10), 4)]
        exact[channel] = np.mean(np.array(every) >= observed - 1e-9)
    df = spark.createDataFrame(rows, "channel string, obs long, interest boolean, value double")
    got = {r.channel: r.p for r in st.permutation_test(df, ["channel"], "obs", 3000).collect()}
    for channel, p in exact.items():
        assert abs(got[channel] - p) < 0.03
    again = {r.channel: r.p for r in st.permutation_test(df.repartition(5), ["channel"], "obs", 3000).collect()}
    assert again == got
    md5 = {r.channel: r.p for r in st.permutation_test(df, ["channel"], "obs", 600, draws="md5").collect()}
    assert all(abs(md5[c] - p) < 0.07 for c, p in exact.items())


def test_batches_do_not_change_the_count(monkeypatch):
    rng = np.random.default_rng(1)
    values, hashes = rng.normal(size=50), rng.integers(0, 2**63, 50).astype(np.uint64)
    whole = st._counted_extremes(values, hashes, 20, 0.1, range(1, 257), 7)
    monkeypatch.setattr(st, "SCORES", 130)
    assert st._counted_extremes(values, hashes, 20, 0.1, range(1, 257), 7) == whole


def test_unknown_draws_are_refused(spark):
    with pytest.raises(ValueError, match="draws"):
        st.permutation_test(spark.range(1), [], "id", 9, draws="dice")

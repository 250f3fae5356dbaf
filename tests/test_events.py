"""Hand-made event fixtures."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trialweave.functions import numeric, text
from trialweave.operators import events as ev


def onsets(df):
    return sorted(r.onset for r in df.collect())


def log(spark, rows):
    return spark.createDataFrame(rows, "subject string, onset double, trial_type string")


def test_orphans_window_bounds(spark):
    stim = [("a", t, "stimulus") for t in (0.0, 10.0, 20.0, 30.0)]
    resp = [("a", t, "response") for t in (1.0, 14.0, 24.001, 30.0)]
    kept = ev.drop_orphans(log(spark, stim + resp), 4.0)
    assert onsets(kept.filter("trial_type = 'stimulus'")) == [0.0, 10.0]
    assert kept.filter("trial_type = 'response'").count() == 4


def test_orphans_without_responses(spark):
    rows = [("a", float(t), "stimulus/1") for t in range(3)] + [("a", 5.0, "cue")]
    assert [r.trial_type for r in ev.drop_orphans(log(spark, rows)).collect()] == ["cue"]


def test_orphans_keep_subjects_apart(spark):
    rows = [("a", 1.0, "stimulus"), ("b", 2.0, "response")]
    assert ev.drop_orphans(log(spark, rows)).count() == 1


def test_orphans_against_pairs(spark):
    """Dense and sparse onsets, one hot subject, decimal window edges."""
    import random

    rng = random.Random(3)
    rows = []
    for subject, n in (("hot", 600), ("x", 40), ("y", 40)):
        for _ in range(n):
            rows.append((subject, round(rng.uniform(-50, 300), 1), rng.choice(["stimulus", "response", "cue"])))
    for window in (0.3, 4.0):
        got = sorted(map(tuple, ev.drop_orphans(log(spark, rows), window).collect()))
        want = sorted(
            r for r in rows
            if r[2] != "stimulus"
            or any(q[2] == "response" and q[0] == r[0] and r[1] < q[1] <= r[1] + window for q in rows)
        )
        assert got == want


def test_trial_numbers(spark):
    rows = log(spark, [("a", float(t), "x") for t in range(5)])
    got = [r.trial for r in ev.trial_numbers(rows).orderBy("onset").collect()]
    assert got == [1, 1, 2, 2, 3]


def test_phoneme_events(spark):
    rows = [("s", "stimulus", 0.10049 + i, 0.2 + i, "AH0") for i in range(6)]
    df = spark.createDataFrame(rows, "subject string, trial_type string, onset double, offset double, label string")
    got = ev.phoneme_events(df, 3, 2000.0, "lexical", ["onset"]).orderBy("onset").collect()
    assert [r.trial for r in got] == [1, 1, 1, 2, 2, 2]
    assert [r.trial_type for r in got] == ["stimulus/1", "stimulus/2", "stimulus/3"] * 2
    assert got[0].sample == 200 and got[0].value == "AH"
    assert set(ev.EVENT_COLUMNS) == set(got[0].asDict())


def test_complete_trials(spark):
    names = ["Start", "Word/Audio", "Word/Go", "Word/Response", "Start", "Word/Audio", "Word/Response", "Start"]
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate(names)], "subject string, at int, name string")
    got = ev.complete_trials(df, ["at"], "Start", ["Word/Audio", "Word/Go", "Word/Response"])
    assert sorted(r["at"] for r in got.collect()) == [0, 1, 2, 3]
    none = df.filter("at > 3")
    assert ev.complete_trials(none, ["at"], "Start", ["Word/Audio", "Word/Go", "Word/Response"]).count() == 4


def test_recode(spark):
    df = spark.createDataFrame(
        [(1, "response/1/T"), (2, "response/2/AH0"), (3, "response/3/AH1")], "i int, name string"
    )
    got = {r.i: (r.label, r.code) for r in ev.recode_events(df, "name").collect()}
    assert got == {1: ("T", 2), 2: ("AH", 1), 3: ("AH", 1)}


def test_unknown_code_is_an_error(spark):
    df = spark.createDataFrame([("QQ",)], "s string")
    with pytest.raises(PySparkException):
        df.select(text.target_code(F.col("s"))).collect()
    with pytest.raises(PySparkException):
        df.select(numeric.to_volts(F.lit(1.0), F.lit("kV"))).collect()


def test_slice_and_pool_arguments(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,)], "i int")
    assert ev.phoneme_slice(df, "i", -1, 3).count() == 4
    assert [r.i for r in ev.phoneme_slice(df, "i", 1, 3).collect()] == [0, 3]
    with pytest.raises(ValueError):
        ev.phoneme_slice(df, "i", 4, 3)
    with pytest.raises(ValueError):
        ev.subject_pool(df, 1, "other")


@pytest.mark.parametrize(
    "value, want", [(0.5, "0.5"), (1.0, "1"), (0.25, "0.25"), (0.125, "0.12"), (99.7, "1e+02"), (12.4, "12"),
                    (0.00001, "1e-05"), (0.0, "0"), (150.0, "1.5e+02")]
)
def test_two_digits(spark, value, want):
    assert want == f"{value:.2g}"
    got = spark.range(1).select(text.two_digits(F.lit(value)).alias("x")).first().x
    assert got == want


def test_cross_result_key(spark):
    got = spark.range(1).select(
        text.cross_result_description(
            F.lit("highGamma"), F.lit("perceptionZscore"), (F.lit(-1.0), F.lit(1.0)), (F.lit(-0.5), F.lit(0.5)),
            F.lit("epoch(band)(power)(sig)"), F.array(F.lit("S1"), F.lit("S2")),
        ).alias("x")
    ).first().x
    assert got == (
        "highGamma(Perception)(Zscore)(alignTW[pre1,post1])(decTW[pre0.5,post0.5])(sigChannel)(pts[S1,S2])"
    )

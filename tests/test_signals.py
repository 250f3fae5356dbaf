"""References, quality, epochs: hand-made fixtures and invariants."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trialweave.operators import epochs as ep, quality as qc, signals as sg


def chunks(spark, channels, subject="s"):
    rows = [(subject, name, 0, 0, [float(v) for v in values]) for name, values in channels.items()]
    return spark.createDataFrame(rows, "subject string, channel string, chunk long, start_sample long, values array<double>")


def by_channel(df):
    return {r.channel: list(r["values"]) for r in df.collect()}


def test_laplacian(spark):
    got = by_channel(sg.reference_laplacian(chunks(spark, {"E1": [1], "E2": [4], "E3": [9], "F1": [5], "ref": [7]})))
    assert got == {"E1": [-3.0], "E2": [-1.0], "E3": [5.0], "F1": [5.0], "ref": [7.0]}


def test_average_sums_to_zero_and_spares_bad(spark):
    data = {"E1": [1, 2], "E2": [3, 6], "E3": [100, 100]}
    bad = spark.createDataFrame([("s", "E3")], "subject string, channel string")
    got = by_channel(sg.reference_average(chunks(spark, data), bad))
    assert got == {"E1": [-1.0, -2.0], "E2": [1.0, 2.0], "E3": [100.0, 100.0]}
    assert sg.set_reference(chunks(spark, data), "common_average").count() == 3
    with pytest.raises(ValueError):
        sg.set_reference(chunks(spark, data), "other")


def test_white_matter_falls_back(spark):
    data = {"E1": [1], "E2": [3], "E3": [10]}
    schema = "subject string, channel string, status_description string"
    pure = spark.createDataFrame([("s", "E1", "pure_white_matter"), ("s", "E2", "white_matter")], schema)
    assert by_channel(sg.reference_white_matter(chunks(spark, data), pure)) == {"E1": [0.0], "E2": [2.0], "E3": [9.0]}
    gone = spark.createDataFrame([("s", "X9", "pure_white_matter"), ("s", "E2", "white_matter")], schema)
    assert by_channel(sg.reference_white_matter(chunks(spark, data), gone)) == {"E1": [-2.0], "E2": [0.0], "E3": [7.0]}


def test_chunks_round_trip(spark):
    long = spark.createDataFrame([("s", "a", i, float(i * i)) for i in range(50)], "subject string, channel string, sample long, value double")
    back = sg.to_long(sg.to_chunks(long.repartition(5), ["subject", "channel"], 16)).orderBy("sample").collect()
    assert [(r["sample"], r.value) for r in back] == [(i, float(i * i)) for i in range(50)]


def test_detrend_removes_a_line(spark):
    df = spark.createDataFrame([("a", i, 3.0 * i + 2) for i in range(20)], "channel string, sample long, value double")
    assert sg.detrend(df, ["channel"]).agg(F.max(F.abs("value")).alias("m")).first().m < 1e-9


def test_good_trials_by_amplitude(spark):
    trials = [[1, 1], [1, 1], [9, 1], [0, 0]]
    rows = [("c", k, t, float(v)) for k, trial in enumerate(trials) for t, v in enumerate(trial)]
    df = spark.createDataFrame(rows, "channel string, trial int, t int, value double")
    got = {r.trial: r.is_good for r in qc.good_trials_amplitude(df, 1.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False}


def test_good_trials_by_step(spark):
    rows = [("c", k, t, float(v)) for k, trial in enumerate([[0, -10, 0], [0, 3, 0]]) for t, v in enumerate(trial)]
    df = spark.createDataFrame(rows, "channel string, trial int, t int, value double")
    assert {r.trial: r.is_good for r in qc.good_trials_step(df, 5.0).collect()} == {0: False, 1: True}
    rows = spark.createDataFrame([("c", 0, 0, 10.0), ("c", 0, 1, 0.0)], "channel string, trial int, t int, value double")
    assert qc.good_trials_step(rows, 5.0, signed=True).first().is_good
    assert not qc.good_trials_step(rows, 5.0).first().is_good


def test_epochs_drop_windows_outside(spark):
    long = spark.createDataFrame([("s", "a", i, float(i)) for i in range(100)], "subject string, channel string, sample long, value double")
    data = sg.to_chunks(long, ["subject", "channel"], 16)
    events = spark.createDataFrame([(i, "s", float(o)) for i, o in enumerate((0, 0.5, 4.5, 9.5))], "event_id int, subject string, onset double")
    got = {r.event_id: list(r["values"]) for r in ep.extract_epochs(events, data, (-0.3, 0.4), 10.0, 16).collect()}
    assert got == {1: [float(v) for v in range(2, 10)], 2: [float(v) for v in range(42, 50)], 3: [float(v) for v in range(92, 100)]}


def test_rescale_and_arguments(spark):
    rows = spark.createDataFrame([("c", 1.0), ("c", 3.0), ("c", None)], "channel string, value double")
    got = [r.value for r in ep.rescale(rows, rows, ["channel"]).collect()]
    assert sorted(v for v in got if v is not None) == [-1.0, 1.0] and None in got
    with pytest.raises(ValueError):
        ep.rescale(rows, rows, ["channel"], "ratio")


def test_impute_falls_back_to_all_classes(spark):
    schema = "trial int, channel string, label int, values array<double>"
    rows = [(0, "c", 0, [1.0, 2.0]), (1, "c", 0, [3.0, 4.0]), (2, "c", 0, None), (3, "c", 1, [5.0, 9.0]), (4, "c", 1, [1.0, None])]
    got = {r.trial: list(r["values"]) for r in ep.impute_by_class(spark.createDataFrame(rows, schema)).collect()}
    assert got[2] == [2.0, 3.0] and got[4] == [3.0, 5.0] and got[3] == [5.0, 9.0]
    noisy = ep.impute_by_class(spark.createDataFrame(rows, schema), noise=0.01)
    a = {r.trial: list(r["values"]) for r in noisy.collect()}
    b = {r.trial: list(r["values"]) for r in noisy.repartition(3).collect()}
    assert a == b and a[2] != [2.0, 3.0] and abs(a[2][0] - 2.0) < 0.1


def test_resolve_rate(spark):
    df = spark.createDataFrame([(None, 500.0), (2000.0, None)], "a double, b double")
    assert sorted(r.fs for r in sg.resolve_rate(df, ["a", "b"]).collect()) == [500.0, 2000.0]
    with pytest.raises(PySparkException):
        sg.resolve_rate(spark.createDataFrame([(None, None)], "a double, b double"), ["a", "b"]).collect()


def test_channel_outliers_two_passes(spark):
    rng = np.random.default_rng(0)
    scale = {f"c{i}": 1.0 for i in range(30)} | {"big": 50.0, "mid": 4.0}
    rows = [("s", c, i, float(v)) for c, s in scale.items() for i, v in enumerate(rng.normal(size=200) * s)]
    df = spark.createDataFrame(rows, "subject string, channel string, sample long, value double")
    assert sorted(r.channel for r in sg.channel_outliers(df).collect()) == ["big", "mid"]


def test_bad_trial_mask_expands(spark):
    phon = spark.createDataFrame([("s", i) for i in range(6)], "subject string, phoneme long")
    mask = spark.createDataFrame([("s", 0, True), ("s", 1, False)], "subject string, trial long, is_good boolean")
    got = {r.phoneme: r.is_good for r in ep.expand_mask(phon, mask, 3, ["subject"]).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False}


def test_average_over_channels_of_unequal_length(spark):
    got = by_channel(sg.reference_average(chunks(spark, {"E1": [1, 2], "E2": [3, 6, 5]})))
    assert got == {"E1": [-1.0, -2.0], "E2": [1.0, 2.0, 0.0]}


def test_load_needs_every_subject(spark):
    df = spark.createDataFrame([("s", "E1", 1e-6), ("s", "Trigger", 1.0)], "subject string, channel string, value double")
    assert [round(r.value, 6) for r in sg.load_microvolts(df, ["s"]).collect()] == [1.0]
    with pytest.raises(ValueError, match="x"):
        sg.load_microvolts(df, ["s", "x"])

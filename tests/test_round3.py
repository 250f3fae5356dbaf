"""Steps that must not grow faster than their input."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml.classification import OneVsRest
from pyspark.sql import functions as F

from trialweave.catalog import QUERIES
from trialweave.operators import decoding as dc, epochs as ep, margin as mg, signals as sg, stats as st, table_functions as tf

FS, CHUNK = 100.0, 16


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(6)
    rows = [(s, c, i, float(rng.normal())) for s in ("a", "b") for c in ("x", "y") for i in range(150 if s == "a" else 70)]
    samples = spark.createDataFrame(rows, "subject string, channel string, sample long, value double")
    return sg.to_chunks(samples, ["subject", "channel"], CHUNK)


@pytest.fixture(scope="module")
def events(spark):
    rows = [("a", i, 0.11 + 0.03 * (i // 2)) for i in range(40)] + [("b", i, 0.2) for i in range(3)]
    return spark.createDataFrame(rows, "subject string, trial int, onset double")


def test_samples_of_a_window_are_not_dealt_by_event(spark, events, chunks):
    out = ep.extract_epochs(events, chunks, (-0.02, 0.03), FS, CHUNK)
    plan = out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert not [keys for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan) if "trial" in keys]
    signal = {(r.subject, r.channel, r.sample): r.value for r in sg.to_long(chunks).collect()}
    want = []
    for e in events.collect():
        low = round(e.onset * FS) - 2
        for channel in ("x", "y"):
            cut = [signal.get((e.subject, channel, i)) for i in range(low, low + 6)]
            if None not in cut:
                want.append((e.subject, e.trial, channel, cut))
    assert sorted((r.subject, r.trial, r.channel, r["values"]) for r in out.collect()) == sorted(want)


def test_epochs_argument_holds_no_more_than_the_windows(spark, events, chunks):
    low = F.round(F.col("onset") * FS).cast("long")
    windows = events.withColumn("lo", low).withColumn("hi", low + 5).withColumn("note", F.lit(float("nan")))
    pieces = tf.window_pieces(windows, chunks, CHUNK)
    held = pieces.groupBy("subject", "trial", "channel").agg(F.sum(F.size("values")).alias("n"))
    assert held.agg(F.max("n")).first()[0] == 5
    # windows of one deal come one after another: equal keys, NaN too, are one window
    tf.register(spark)
    cut = spark.sql("SELECT * FROM epochs(TABLE({p}))", p=pieces).collect()
    assert len(cut) == 2 * events.count() and {len(r["values"]) for r in cut} == {5}


def test_all_axes_of_many_long_trials(spark, tmp_path):
    n = 2 * 258 * 64  # 258 long trials a subject
    vec = np.random.default_rng(1).normal(size=(n, 64)).astype("f4")
    pq.write_table(
        pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(vec), pa.list_(pa.float32())), "label": pa.array(np.arange(n) % 10, pa.int32())}),
        str(tmp_path / "embeddings.parquet"),
    )
    long = vec.astype(float).reshape(-1, 4096)
    got = {r.subject: r for r in QUERIES["pca_long"](spark, str(tmp_path)).collect()}
    for subject in (0, 1):
        assert got[subject].n == 258 and got[subject].explained == 1.0
        assert abs(got[subject].variance - long[subject::2].var(axis=0, ddof=1).sum()) < 1e-5


@pytest.mark.parametrize("deviations", [8.0, 0.0])
def test_large_keys_are_not_copied_for_every_permutation(spark, monkeypatch, deviations):
    rng = np.random.default_rng(8)
    rows = [(c, i, bool(i % 3 == 0), float(rng.normal() + 0.1 * (i % 3 == 0))) for c in ("x", "y") for i in range(700)]
    table = spark.createDataFrame(rows, "channel string, obs long, interest boolean, value double")
    want = {r.channel: r.p for r in st.permutation_test(table, ["channel"], "obs", 49, draws="md5").collect()}
    ranked = []
    hashed_rank = st.hashed_rank
    monkeypatch.setattr(st, "hashed_rank", lambda *a, **k: ranked.append(1) or hashed_rank(*a, **k))
    monkeypatch.setattr(st, "OBSERVATIONS", 100)
    monkeypatch.setattr(st, "PART", 150, raising=False)
    monkeypatch.setattr(st, "DEVIATIONS", deviations, raising=False)
    got = {r.channel: r.p for r in st.permutation_test(table, ["channel"], "obs", 49, draws="md5").collect()}
    assert got == want and len(ranked) == (deviations == 0)


def test_support_vectors_of_pairs_lie_in_rows_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("s", i, i % 3, (rng.normal(size=4) + 2 * np.eye(4)[i % 3]).tolist()) for i in range(150)]
    table = spark.createDataFrame(rows, "subject string, trial long, label int, vec array<double>")
    seen, fit = [], mg.fit
    monkeypatch.setattr(mg, "fit", lambda *a, **k: seen.append(fit(*a, **k)) or seen[-1])
    predicted = [
        sorted(map(tuple, dc.decode_within(table, k=3, n_iter=1, classifier="margin", rows_per_block=n).collect()))
        for n in (1000, 40)
    ]
    assert len(predicted[0]) == 150
    assert sum(a == b for a, b in zip(*predicted)) >= 147
    for pairs in seen:
        assert "pairs" not in pairs.columns
        assert sorted(tuple(r) for r in pairs.select("test_fold", "first", "second").collect()) == [
            (f, a, b) for f in range(3) for a, b in ((0, 1), (0, 2), (1, 2))
        ]


def test_linear_folds_take_one_task_an_iteration(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, i // 3 % 2, (rng.normal(size=4) + 3 * np.eye(4)[i % 3]).tolist()) for i in range(90)]
    table = spark.createDataFrame(rows, "trial long, label int, fold int, vec array<double>").repartition(6)
    trained, fit = [], OneVsRest.fit
    monkeypatch.setattr(OneVsRest, "fit", lambda self, points: trained.append(points.rdd.getNumPartitions()) or fit(self, points))
    got = sorted(map(tuple, dc.decode_linear_folds(table, 2, 20).collect()))
    assert trained == [1, 1] and [r[0] for r in got] == list(range(90))
    alone = [r for fold in (0, 1) for r in map(tuple, dc.decode_linear(table, fold, 20).collect())]
    assert got == sorted(alone)

"""Bucketed samples: same results, no exchange of samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import epochs as ep, signals as sg
from trialweave.sources import stored

CHUNK, FS, BUCKETS = 16, 100.0, 8


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(4)
    rows = [(s, c, i, float(rng.normal())) for s in ("a", "b") for c in ("x", "y", "z") for i in range(200 if s == "a" else 90)]
    return sg.to_chunks(spark.createDataFrame(rows, "subject string, channel string, sample long, value double"), ["subject", "channel"], CHUNK)


@pytest.fixture(scope="module")
def table(spark, chunks, tmp_path_factory):
    name = "stored_samples_test"
    stored.write_samples(chunks, name, BUCKETS, str(tmp_path_factory.mktemp("stored") / "samples"), "overwrite")
    yield name
    spark.sql(f"DROP TABLE {name}")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_average_reference_has_no_exchange(spark, chunks, table, no_broadcast):
    out = sg.reference_average(stored.read_samples(spark, table))
    text = plan(out)
    assert "Exchange" not in text and "Bucketed: true" in text
    got = {(r.subject, r.channel, r.chunk): r["values"] for r in out.collect()}
    want = {(r.subject, r.channel, r.chunk): r["values"] for r in sg.reference_average(chunks).collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        np.testing.assert_allclose(got[key], values, atol=1e-12)


def test_epochs_move_the_windows_only(spark, chunks, table, no_broadcast):
    events = spark.createDataFrame([("a", i, 0.2 + 0.1 * i) for i in range(15)] + [("b", 0, 0.4)], "subject string, trial int, onset double")
    samples = stored.read_samples(spark, table)
    out = ep.extract_epochs(events, samples, (-0.1, 0.2), FS, CHUNK)
    lines = plan(out).splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    # from the scan up to the join there is no exchange: pieces are shuffled after the join, windows before it
    join = max(i for i, line in enumerate(lines[:scan]) if "SortMergeJoin" in line or "ShuffledHashJoin" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    side = [line for i, line in enumerate(lines[join + 1 : scan + 1]) if depth(line) <= depth(lines[scan])]
    on_path, level = [], depth(lines[scan]) + 1
    for line in reversed(lines[join + 1 : scan + 1]):
        if depth(line) < level:
            on_path.append(line)
            level = depth(line)
    assert side and not any("Exchange" in line for line in on_path)
    columns = ("subject", "trial", "channel", "values")
    assert rows(out, *columns) == rows(ep.extract_epochs(events, chunks, (-0.1, 0.2), FS, CHUNK), *columns)


def test_one_file_a_bucket_and_long_recordings_spread(spark, table):
    files = stored.read_samples(spark, table).select("subject", F.input_file_name().alias("file"))
    assert files.select("file").distinct().count() <= BUCKETS
    assert files.filter("subject = 'a'").select("file").distinct().count() > BUCKETS // 2


def test_other_tables_are_refused(spark, chunks, tmp_path):
    with pytest.raises(ValueError, match="start_sample"):
        stored.write_samples(chunks.drop("start_sample"), "never_written", 4)
    chunks.write.option("path", str(tmp_path / "plain")).saveAsTable("plain_samples_test")
    try:
        with pytest.raises(ValueError, match="not bucketed"):
            stored.read_samples(spark, "plain_samples_test")
    finally:
        spark.sql("DROP TABLE plain_samples_test")

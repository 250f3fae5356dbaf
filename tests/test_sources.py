"""Recording files, text tables and geometry on real files."""

import pytest
from pyspark.sql import functions as F

from recording_bytes import encode_recording
from trialweave.operators import channels as ch, geometry as geo
from trialweave.sources import recordings as rec, tables as tb


def test_recording_files(spark, tmp_path):
    raw = [[32768, 32768, 32768, 32768, 32]] * 256
    whole = encode_recording(raw, False)
    (tmp_path / "a.rhd").write_bytes(whole)
    (tmp_path / "b.rhd").write_bytes(encode_recording(raw, True))
    (tmp_path / "c.rhd").write_bytes(b"nothing")
    (tmp_path / "d.txt").write_bytes(whole)
    files = rec.read_recordings(spark, str(tmp_path))
    rejects = {r.path[-5]: r.reason for r in rec.rejected_recordings(files).collect()}
    assert set(rejects) == {"b", "c"} and "block" in rejects["b"]
    chunks = rec.decode_recordings(files)
    scaled = rec.scaled_samples(chunks).collect()
    assert {(r.kind, r.channel) for r in scaled} == {("amplifier", 0), ("amplifier", 1), ("adc", 0), ("adc", 1)}
    assert all(set(r["values"]) == {0.0} and len(r["values"]) == 256 for r in scaled)
    names = rec.recording_channels(files).filter("kind = 'amplifier'").orderBy("channel").collect()
    assert [(r.native_name, r.impedance) for r in names] == [("A-000", 1e5), ("A-001", 2e5)]
    level = rec.digital_lines(chunks, rec.recording_channels(files)).first()
    assert set(level.levels) == {True}
    stamps = chunks.filter("kind = 'timestamp'").first()
    assert list(stamps.raw) == list(range(256)) and stamps.fs == 2000.0 and stamps.notch == 60


def test_old_versions_have_short_blocks():
    import struct

    data = bytearray(encode_recording([[1, 2, 3, 4, 5]], False))
    assert rec.parse_header(bytes(data))["block"] == 128
    with pytest.raises(rec.NotARecording):
        rec.parse_header(struct.pack("<I", 1))
    with pytest.raises(rec.NotARecording):
        rec.parse_header(bytes(data[:40]))


def test_text_tables(spark, tmp_path):
    (tmp_path / "words.txt").write_text("0.5\t0.9\thello\n1.5\t1.2\tworld\n")
    rows = tb.read_alignment(spark, str(tmp_path / "words.txt")).orderBy("onset").collect()
    assert [(r.onset, r.label) for r in rows] == [(0.5, "hello"), (1.5, "world")]
    events = spark.createDataFrame([("s", 1, 0.5, 0.4, "hi", "stimulus", 10)], tb.EVENTS_SCHEMA)
    described = tb.describe_events(events)
    assert described.schema["onset"].metadata["units"] == "s"
    out = str(tmp_path / "events")
    tb.write_derivative(described, out, "tsv")
    tb.write_derivative(described.union(described), out, "tsv")  # kept as it is
    assert tb.read_tsv(spark, out, tb.EVENTS_SCHEMA).collect() == events.collect()
    tb.write_derivative(described.union(described), out, "tsv", overwrite=True)
    assert tb.read_tsv(spark, out, tb.EVENTS_SCHEMA).count() == 2
    tb.write_derivative(events, str(tmp_path / "p"), partition_by=["subject"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    with pytest.raises(ValueError):
        tb.write_derivative(events, out, "xls")


def test_electrode_text(spark, tmp_path):
    (tmp_path / "e.txt").write_text("LA 1 1.0 2.0 3.0 L G\nRB 12 -1 0 0.5 R G\n")
    got = {r.name: (r.x, r.y, r.z) for r in tb.read_electrodes(spark, str(tmp_path / "e.txt")).collect()}
    assert got == {"LA1": (1.0, 2.0, 3.0), "RB12": (-1.0, 0.0, 0.5)}


def test_require_inputs(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "path string")
    tb.require_inputs(expected, expected)
    with pytest.raises(FileNotFoundError, match="b"):
        tb.require_inputs(expected, expected.filter("path = 'a'"))


def cells(spark, grid):
    rows = [("s", r, c, v) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "subject string, row int, col int, channel_number int")


def test_composite_map(spark):
    got = ch.composite_map(cells(spark, [[0, 1], [None, 2]]), 2).orderBy("row", "col").collect()
    assert [r.channel_number for r in got] == [0, 1, None, 2, None, None, 3, 4, None, 5]
    assert [r.row for r in got] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_macro_names(spark):
    got = {r.channel_number: (r.name, r.electrode_type) for r in ch.channel_names(cells(spark, [[0, 7], [7, 1]])).collect()}
    assert got == {0: ("R0-C0", "micro"), 7: ("R0-C1", "macro"), 1: ("R1-C1", "micro")}


def test_unknown_map_channel_is_an_error(spark):
    grid = cells(spark, [[0, 9]])
    names = ch.channel_names(grid)
    with pytest.raises(Exception, match="out of range"):
        ch.chanmap_table(grid, names.filter("channel_number < 9"), names).collect()


def test_flood_fill_lowest_macro_wins(spark):
    grid = cells(spark, [[5, None, None], [1, 2, None], [None, 3, 4]])
    macro = grid.withColumn("is_macro", F.col("channel_number").isin(5, 4))
    got = {(r.row, r.col): r.channel_number for r in geo.flood_fill(macro).collect()}
    assert got[(0, 1)] == got[(0, 2)] == got[(1, 2)] == 4 and got[(2, 0)] is None


def test_nearest_vertex_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    # two thirds of the vertices in one tight cluster, many of them equal; one far point
    v = np.vstack([rng.normal(size=(150, 3)) * 0.01, np.repeat(rng.normal(size=(5, 3)) * 0.01, 40, axis=0), rng.normal(size=(150, 3)) * 5])
    p = np.vstack([rng.normal(size=(40, 3)) * 3, [[60.0, 60.0, -60.0]]])
    vertices = spark.createDataFrame([("lh", i, *map(float, x)) for i, x in enumerate(v)], "hemi string, vertex long, x double, y double, z double")
    points = spark.createDataFrame([("lh", i, *map(float, x)) for i, x in enumerate(p)], "hemi string, name long, x double, y double, z double")
    got = {r.name: r.vertex for r in geo.nearest_vertex(points, vertices, ["hemi"], "name").collect()}
    d = ((p[:, None] - v[None]) ** 2).sum(axis=2)
    assert got == {i: int(d[i].argmin()) for i in range(len(p))}


def test_projection_chain(spark):
    surface = "hemi string, vertex long, x double, y double, z double"
    pial = [("lh", i, float(i), 0.0, 0.0) for i in range(4)]
    sphere = [("lh", i, 0.0, float(10 * i), 0.0) for i in range(4)]
    template_sphere = [("lh", i, 0.0, float(10 * (3 - i)) + 1, 0.0) for i in range(4)]
    template_pial = [("lh", i, 100.0 + i, 0.0, 0.0) for i in range(4)]
    subject = lambda rows: spark.createDataFrame([("s", *r) for r in rows], "subject string, " + surface)
    electrodes = spark.createDataFrame([("s", "lh", "LA1", 1.2, 0.1, 0.0)], "subject string, hemi string, name string, x double, y double, z double")
    got = geo.project_electrodes(
        electrodes, subject(pial), subject(sphere), spark.createDataFrame(template_sphere, surface),
        spark.createDataFrame(template_pial, surface),
    ).first()
    assert (got.subject, got.name, got.vertex, got.x) == ("s", "LA1", 2, 102.0)

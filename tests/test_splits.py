"""The splittable recording source and the committing derivative sink."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recording_bytes import encode_recording
from trialweave.sources import recordings as rec, splits as sp


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sp.register(spark)
    base = tmp_path_factory.mktemp("recordings")
    for name, n in (("a", 128 * 37), ("b", 128 * 4)):
        (base / f"{name}.rhd").write_bytes(encode_recording([[i, 2 * i % 65536, 7, i % 11, i % 2] for i in range(n)], False))
    (base / "cut.rhd").write_bytes(encode_recording([[1, 2, 3, 4, 5]] * 128, True))
    (base / "other.rhd").write_bytes(b"nothing")
    (base / "empty.rhd").write_bytes(b"")
    return str(base)


def split(spark, folder, blocks=8):
    # a block of these files has 1 536 bytes
    return spark.read.format("recording_blocks").option("blocksPerChunk", blocks).option("splitBytes", 1 << 14).load(folder)


def test_equals_whole_files(spark, folder):
    whole = rec.decode_recordings(rec.read_recordings(spark, folder), 8)
    parts = split(spark, folder)
    assert parts.rdd.getNumPartitions() > 4  # the longer file alone has five ranges
    key = lambda r: (r.path, r.kind, r.channel, r.chunk)
    assert sorted(parts.collect(), key=key) == sorted(whole.collect(), key=key)
    assert rec.scaled_samples(parts).count() == rec.scaled_samples(whole).count()


@pytest.mark.parametrize("condition", [
    "chunk = 2", "kind = 'adc' AND channel = 1", "start_sample >= 3000 AND start_sample < 4000", "kind IN ('timestamp', 'digital_in')",
    "path LIKE '%b.rhd'", "channel = 9", "kind = 'amplifier' OR chunk = 0", "start_sample > 1024 AND chunk <= 3",
])
def test_filters_give_the_same_rows(spark, folder, condition):
    key = lambda r: (r.path, r.kind, r.channel, r.chunk)
    whole = rec.decode_recordings(rec.read_recordings(spark, folder), 8)
    assert sorted(split(spark, folder).filter(condition).collect(), key=key) == sorted(whole.filter(condition).collect(), key=key)


def test_filters_skip_bytes(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    def read(*filters):
        reader = sp.RecordingReader({"path": folder, "blocksPerChunk": "8", "splitBytes": str(1 << 14)})
        assert list(reader.pushFilters(filters)) == list(filters)
        ranges = reader.partitions()
        for part in ranges:
            for _ in reader.read(part):
                pass
        return len(ranges), reader.bytes_read

    ranges, everything = read()
    size = rec.block_type(rec.parse_header(open(f"{folder}/b.rhd", "rb").read()))["adc"].itemsize
    assert everything == 41 * rec.block_type(rec.parse_header(open(f"{folder}/b.rhd", "rb").read())).itemsize
    late = read(GreaterThanOrEqual(("chunk",), 4))
    assert late[0] == 1 and late[1] * 41 == everything * 5  # the last five blocks of one file
    one = read(EqualTo(("kind",), "adc"), EqualTo(("channel",), 1))
    assert one[0] == ranges and one[1] == 41 * size // 2
    assert read(EqualTo(("path",), "file:/elsewhere"))[0] == 0


def listing(path):
    return sorted(p.name for p in path.iterdir()) if path.exists() else []


def test_sink_commits_once(spark, folder, tmp_path):
    rows = spark.range(100, numPartitions=4).select("id", (F.col("id") / 2).alias("half"), F.concat(F.lit("x"), "id").alias("name"))
    out = tmp_path / "table"
    rows.write.format("derivative").option("units", "s").mode("append").save(str(out))
    assert (out / "_SUCCESS").read_text() == "100" and json.loads((out / "description.json").read_text()) == {"units": "s"}
    read = spark.read.option("sep", "\t").option("header", True).option("pathGlobFilter", "part-*").schema("id long, half double, name string").csv(str(out))
    assert sorted(read.collect()) == sorted(rows.collect())
    before = listing(out)
    rows.limit(3).write.format("derivative").mode("append").save(str(out))  # a rerun keeps the finished table
    assert listing(out) == before and listing(tmp_path) == ["table"]
    rows.limit(3).write.format("derivative").option("kind", "parquet").mode("overwrite").save(str(out))
    assert (out / "_SUCCESS").read_text() == "3" and spark.read.option("pathGlobFilter", "part-*").parquet(str(out)).count() == 3
    with pytest.raises(PySparkException):
        rows.write.format("derivative").option("existing", "error").mode("append").save(str(out))
    assert (out / "_SUCCESS").read_text() == "3" and listing(tmp_path) == ["table"]


def test_failed_task_leaves_nothing(spark, folder, tmp_path):
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(PySparkException):
        bad.write.format("derivative").mode("append").save(str(tmp_path / "table"))
    assert listing(tmp_path) == []
    spark.range(0).write.format("derivative").mode("append").save(str(tmp_path / "none"))
    assert listing(tmp_path / "none") == ["_SUCCESS"]


def test_commit_drops_parts_of_lost_attempts(tmp_path):
    import pyarrow as pa

    writer = sp.DerivativeWriter({"path": str(tmp_path / "t"), "kind": "parquet"}, False)
    batch = pa.RecordBatch.from_pydict({"a": [1, 2]})
    kept, _ = writer.write(iter([batch])), writer.write(iter([batch]))  # the second attempt's message never arrives
    writer.commit([kept, None])
    assert len([n for n in listing(tmp_path / "t") if n.startswith("part-")]) == 1

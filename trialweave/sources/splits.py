"""Recording files as a splittable data source, and derivative tables as a committing sink.

``spark.read.format("recording_blocks").load(folder)`` has the columns of ``recordings.decode_recordings`` but one input
partition per range of data blocks, so a file of any size is read by as many tasks as it has ranges, and no task holds more
than a chunk. Filters on ``path``, ``kind``, ``channel``, ``chunk`` and ``start_sample`` are used to leave out files, ranges,
and bytes within blocks (with ``spark.sql.python.filterPushdown.enabled``); Spark checks them again on the rows.

``df.write.format("derivative").save(path)`` writes part files to a folder of its own beside the target. Only the commit,
after every task has succeeded, decides whether the target is kept or replaced and moves the folder into place.

Paths are local ones or URIs of stores that pyarrow reaches; for others, ``recordings.read_recordings`` goes through Spark.
Register both with ``register(spark)``.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)

from .recordings import BLOCK_SCHEMA, NotARecording, block_type, parse_header

SPLIT_BYTES = 64 << 20
_NAMES = [part.split()[0] for part in BLOCK_SCHEMA.split(", ")]
_TYPES = [
    pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(),
    pa.list_(pa.int32()),
]


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def read_header(file, size: int) -> dict:
    """Header of an open file, from as many first bytes as it takes."""
    have, data = 1 << 16, b""
    while True:
        file.seek(0)
        data = file.read(min(have, size))
        try:
            return parse_header(data)
        except NotARecording:
            if len(data) >= size or data[:4] != b"\x02\x27\x91\xc6":
                raise
            have *= 4


@dataclass
class BlockRange(InputPartition):
    """Blocks ``first`` to ``stop`` of a file; ``first`` starts a chunk."""

    path: str
    first: int
    stop: int


@dataclass
class _Bounds:
    """What the pushed filters leave: equal values, and closed ranges of numbers."""

    equal: dict[str, set]
    low: dict[str, float]
    high: dict[str, float]

    def allows(self, name: str, value) -> bool:
        known = self.equal.get(name)
        if known is not None and value not in known:
            return False
        if isinstance(value, str):
            return True
        return self.low.get(name, -np.inf) <= value <= self.high.get(name, np.inf)


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.pattern = options.get("pattern", "*.rhd")
        self.chunk_blocks = int(options.get("blocksPerChunk", 128))
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.bounds = _Bounds({}, {}, {})
        self.bytes_read = 0

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in ("path", "kind", "channel", "chunk", "start_sample"):
                if isinstance(f, (EqualTo, In)):
                    values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.bounds.equal[name] = self.bounds.equal.get(name, values) & values
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.bounds.low[name] = max(self.bounds.low.get(name, -np.inf), f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.bounds.high[name] = min(self.bounds.high.get(name, np.inf), f.value)
            yield f  # the rows are checked again

    def _files(self):
        fs, base = _store(self.folder)
        info = fs.get_file_info(base)
        found = [info] if info.type == pa.fs.FileType.File else fs.get_file_info(pa.fs.FileSelector(base))
        for info in sorted(found, key=lambda i: i.path):
            if info.type == pa.fs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern):
                name = f"file:{info.path}" if isinstance(fs, pa.fs.LocalFileSystem) else f"{self.folder.split('://')[0]}://{info.path}"
                if self.bounds.allows("path", name):
                    yield fs, info, name

    def _wanted(self, header: dict, first: int) -> bool:
        """Whether a chunk that starts at block ``first`` can hold rows the filters leave."""
        if not self.bounds.allows("chunk", first // self.chunk_blocks):
            return False
        dtype = block_type(header)
        return any(
            self.bounds.allows("kind", kind) and self.bounds.allows("start_sample", first * dtype[kind].shape[1]) for kind in dtype.names
        )

    def partitions(self) -> list[BlockRange]:
        out = []
        for fs, info, name in self._files():
            try:
                with fs.open_input_file(info.path) as file:
                    header = read_header(file, info.size)
            except NotARecording:
                continue
            size = block_type(header).itemsize
            blocks, rest = divmod(info.size - header["size"], size)
            if rest:
                continue
            step = max(1, self.split_bytes // (size * self.chunk_blocks)) * self.chunk_blocks
            for first in range(0, blocks, step):
                stop = min(first + step, blocks)
                if any(self._wanted(header, c) for c in range(first, stop, self.chunk_blocks)):
                    out.append(BlockRange(name, first, stop))
        return out

    def read(self, partition: BlockRange) -> Iterator[pa.RecordBatch]:
        fs, path = _store(partition.path)
        with fs.open_input_file(path) as file:
            header = read_header(file, file.size())
            dtype = block_type(header)
            orders: dict[str, list[int]] = {kind: [] for kind in dtype.names}
            for channel in header["channels"]:
                if channel["kind"] in orders:
                    orders[channel["kind"]].append(channel["native_order"])
            places = [
                (kind, i, dtype.fields[kind][1] + i * dtype[kind].base.itemsize * dtype[kind].shape[1])
                for kind in dtype.names if self.bounds.allows("kind", kind)
                for i in range(dtype[kind].shape[0]) if self.bounds.allows("channel", i)
            ]
            for first in range(partition.first, partition.stop, self.chunk_blocks):
                if self._wanted(header, first) and places:
                    stop = min(first + self.chunk_blocks, partition.stop)
                    yield self._chunk(file, header, dtype, orders, places, first, stop, partition.path)

    def _chunk(self, file, header, dtype, orders, places, first, stop, path) -> pa.RecordBatch:
        """One chunk; where few bytes of a block are wanted only those are read."""
        start, size = header["size"] + first * dtype.itemsize, dtype.itemsize
        wanted = sum(dtype[kind].base.itemsize * dtype[kind].shape[1] for kind, _, _ in places)
        whole = None
        if 4 * wanted > size:
            whole = np.frombuffer(self._take(file, start, (stop - first) * size), np.uint8).reshape(-1, size)
        columns: list[list] = [[] for _ in _NAMES]
        for kind, index, offset in places:
            per_block = dtype[kind].shape[1]
            n = dtype[kind].base.itemsize * per_block
            if whole is not None:
                raw = np.ascontiguousarray(whole[:, offset : offset + n])
            else:
                raw = np.frombuffer(b"".join(self._take(file, start + b * size + offset, n) for b in range(stop - first)), np.uint8)
            values = raw.reshape(-1).view(dtype[kind].base).astype(np.int32)
            order = orders[kind][index] if index < len(orders[kind]) else index
            row = (
                path, kind, index, order, first // self.chunk_blocks, first * per_block, header["fs"], header["board_mode"],
                header["notch"], header["version"][0], values,
            )
            for column, value in zip(columns, row):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    def _take(self, file, at: int, n: int) -> bytes:
        file.seek(at)
        self.bytes_read += n
        return file.read(n)


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording_blocks"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)


# --- derivative sink ----------------------------------------------------------------


@dataclass
class Part(WriterCommitMessage):
    """A part file that a task has finished."""

    path: str
    rows: int


class DerivativeWriter(DataSourceArrowWriter):
    """Part files in a draft folder, moved into place by the commit.

    Options: ``kind`` (``tsv`` or ``parquet``), ``existing`` (``keep``, ``overwrite`` or ``error``), and any others,
    which go to a JSON file beside the parts. A finished target holds ``_SUCCESS`` with the number of rows.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.target = options["path"].rstrip("/")
        self.kind = options.get("kind", "tsv")
        self.existing = "overwrite" if overwrite else options.get("existing", "keep")
        if self.kind not in ("tsv", "parquet") or self.existing not in ("keep", "overwrite", "error"):
            raise ValueError(f"unknown option: {self.kind}, {self.existing}")
        self.notes = {k: v for k, v in options.items() if k not in ("path", "kind", "existing")}
        self.draft = f"{self.target}.draft-{uuid.uuid4().hex}"

    def write(self, iterator) -> Part:
        fs, folder = _store(self.draft)
        batches = (b for b in iterator if b.num_rows)
        first = next(batches, None)
        if first is None:
            return Part("", 0)
        fs.create_dir(folder, recursive=True)
        path, rows = f"{folder}/part-{uuid.uuid4().hex}.{self.kind}", 0
        with fs.open_output_stream(path) as sink:
            if self.kind == "tsv":
                writer = pa.csv.CSVWriter(sink, first.schema, write_options=pa.csv.WriteOptions(delimiter="\t"))
            else:
                writer = pa.parquet.ParquetWriter(sink, first.schema)
            with writer:
                for batch in chain([first], batches):
                    writer.write_batch(batch)
                    rows += batch.num_rows
        return Part(path, rows)

    def commit(self, messages) -> None:
        """Keep what the successful tasks wrote, and nothing that a lost attempt left."""
        fs, folder = _store(self.draft)
        target = _store(self.target)[1]
        done = fs.get_file_info(f"{target}/_SUCCESS").type == pa.fs.FileType.File
        if done and self.existing == "error":
            self.abort(messages)
            raise FileExistsError(self.target)
        if done and self.existing == "keep":
            return self.abort(messages)
        fs.create_dir(folder, recursive=True)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.path)
        named = {m.path for m in parts}
        for info in fs.get_file_info(pa.fs.FileSelector(folder)):
            if info.path not in named and info.base_name.startswith("part-"):
                fs.delete_file(info.path)
        if self.notes:
            with fs.open_output_stream(f"{folder}/description.json") as sink:
                sink.write(json.dumps(self.notes, sort_keys=True).encode())
        with fs.open_output_stream(f"{folder}/_SUCCESS") as sink:
            sink.write(str(sum(m.rows for m in parts)).encode())
        if fs.get_file_info(target).type == pa.fs.FileType.Directory:
            fs.delete_dir(target)
        fs.move(folder, target)

    def abort(self, messages) -> None:
        fs, folder = _store(self.draft)
        if fs.get_file_info(folder).type == pa.fs.FileType.Directory:
            fs.delete_dir(folder)


class DerivativeSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "derivative"

    def writer(self, schema, overwrite: bool) -> DerivativeWriter:
        return DerivativeWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session and let filters reach the reader."""
    spark.dataSource.register(RecordingSource)
    spark.dataSource.register(DerivativeSink)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

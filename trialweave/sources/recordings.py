"""Recording files: selection, concatenation, decoding of the binary layout."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import digital_bit, scale_analog
from ..plans import running_sum


def file_range(files: DataFrame, first: int, last: int) -> DataFrame:
    """Files ``first``..``last`` (1-based, both included) of a subject in path order.

    The upper bound on the row number lets every task drop all but ``last`` files of a
    subject before the shuffle.
    """
    order = Window.partitionBy("subject").orderBy("path")
    numbered = files.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= last)
    return numbered.filter(F.col("position") >= first)


def concat_offsets(files: DataFrame, order: Sequence[str]) -> DataFrame:
    """First sample of each file on the joint time axis of its subject."""
    summed = running_sum(files, ["subject"], list(order), "n_samples", "__upto")
    return summed.withColumn("start_sample", F.col("__upto") - F.col("n_samples")).drop("__upto")


# --- binary layout --------------------------------------------------------------

# --- fixed values -------------------------------------------------------------
MAGIC = 0xC6912702
SIGNAL_KINDS = {0: "amplifier", 1: "aux", 2: "supply", 3: "adc", 4: "digital_in", 5: "digital_out"}
NOTCH_MODES = {0: 0, 1: 50, 2: 60}
NO_TEXT = 0xFFFFFFFF
CHANNEL_RECORD = "<hhhhhhhhhhff"  # orders, type, enabled, chip, stream, 4 trigger words, impedance
# ------------------------------------------------------------------------------


class NotARecording(ValueError):
    """The bytes do not start like a recording, or the header is incomplete."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, fmt: str):
        try:
            values = struct.unpack_from(fmt, self.data, self.at)
        except struct.error as error:
            raise NotARecording("header ends early") from error
        self.at += struct.calcsize(fmt)
        return values if len(values) > 1 else values[0]

    def text(self) -> str:
        size = self.take("<I")
        if size == NO_TEXT:
            return ""
        if self.at + size > len(self.data):
            raise NotARecording("header ends early")
        out = self.data[self.at : self.at + size].decode("utf-16-le")
        self.at += size
        return out


def parse_header(data: bytes) -> dict:
    """Header of one recording: version, rate, board mode, notch, channels by kind, size."""
    r = _Reader(data)
    if r.take("<I") != MAGIC:
        raise NotARecording("unrecognised file type")
    version = r.take("<hh")
    fs = r.take("<f")
    r.take("<hffffff")  # bandwidth settings
    notch = NOTCH_MODES.get(r.take("<h"), 0)
    r.take("<ff")  # impedance test frequencies
    notes = [r.text() for _ in range(3)]
    n_temperature = r.take("<h") if version >= (1, 1) else 0
    board_mode = r.take("<h") if version >= (1, 3) else 0
    reference = r.text() if version[0] > 1 else ""
    channels = []
    for group in range(1, r.take("<h") + 1):
        port, prefix = r.text(), r.text()
        enabled, count, _ = r.take("<hhh")
        if not enabled:
            continue
        for _ in range(count):
            native, custom = r.text(), r.text()
            record = r.take(CHANNEL_RECORD)
            if not record[3]:
                continue
            if record[2] not in SIGNAL_KINDS:
                raise NotARecording("unknown channel type")
            channels.append(
                {
                    "kind": SIGNAL_KINDS[record[2]], "port_name": port, "port_prefix": prefix,
                    "port_number": group, "native_name": native, "custom_name": custom,
                    "native_order": record[0], "custom_order": record[1], "chip_channel": record[4],
                    "board_stream": record[5], "impedance": record[10], "phase": record[11],
                }
            )
    return {
        "version": version, "fs": fs, "notch": notch, "notes": notes, "n_temperature": n_temperature,
        "board_mode": board_mode, "reference": reference, "channels": channels, "size": r.at,
        "block": 128 if version[0] > 1 else 60,
    }


def block_type(header: dict) -> np.dtype:
    """One data block as a numpy record: timestamps, then each kind in file order."""
    n = header["block"]
    count = {kind: 0 for kind in SIGNAL_KINDS.values()}
    for channel in header["channels"]:
        count[channel["kind"]] += 1
    stamp = "<i4" if header["version"] >= (1, 2) else "<u4"
    fields = [
        ("timestamp", stamp, (1, n)),
        ("amplifier", "<u2", (count["amplifier"], n)),
        ("aux", "<u2", (count["aux"], n // 4)),
        ("supply", "<u2", (count["supply"], 1)),
        ("temperature", "<u2", (header["n_temperature"], 1)),
        ("adc", "<u2", (count["adc"], n)),
        ("digital_in", "<u2", (min(count["digital_in"], 1), n)),
        ("digital_out", "<u2", (min(count["digital_out"], 1), n)),
    ]
    return np.dtype([f for f in fields if f[2][0] > 0])


def _problem(data: bytes) -> str | None:
    try:
        header = parse_header(data)
    except NotARecording as error:
        return str(error)
    if (len(data) - header["size"]) % block_type(header).itemsize:
        return "not a whole number of data blocks"
    return None


def read_recordings(spark: SparkSession, path: str, pattern: str = "*.rhd") -> DataFrame:
    """Recording files as rows (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def rejected_recordings(files: DataFrame) -> DataFrame:
    """Files that are not recordings or end inside a block, with the reason."""

    @F.pandas_udf("string")
    def reason(content: pd.Series) -> pd.Series:
        return content.map(_problem)

    return files.select("path", reason("content").alias("reason")).filter(F.col("reason").isNotNull())


CHANNEL_SCHEMA = (
    "path string, kind string, channel int, port_name string, port_prefix string, port_number int, "
    "native_name string, custom_name string, native_order int, custom_order int, chip_channel int, "
    "board_stream int, impedance float, phase float"
)
BLOCK_SCHEMA = (
    "path string, kind string, channel int, native_order int, chunk long, start_sample long, "
    "fs double, board_mode int, notch int, major_version int, raw array<int>"
)


def recording_channels(files: DataFrame) -> DataFrame:
    """Channel metadata, one row per enabled channel; ``channel`` counts within its kind."""
    names = [part.split()[0] for part in CHANNEL_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                if _problem(content) is not None:
                    continue
                seen: dict[str, int] = {}
                rows = []
                for channel in parse_header(content)["channels"]:
                    index = seen.get(channel["kind"], 0)
                    seen[channel["kind"]] = index + 1
                    rows.append({"path": path, "channel": index, **channel})
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, CHANNEL_SCHEMA)


def decode_recordings(files: DataFrame, blocks_per_chunk: int = 128) -> DataFrame:
    """Raw 16-bit words of all accepted files, in chunks per signal kind and channel.

    The kind ``timestamp`` carries the sample counter, ``digital_in``/``digital_out`` one
    16-bit word for all lines of a direction. ``start_sample`` counts at the kind's own
    rate (aux a quarter, supply and temperature once per block). Scaling, bit unpacking
    and gap counting are column expressions on the result. A file is decoded a chunk at a
    time, so the output of a task never holds more than one chunk of a file.
    """
    names = [part.split()[0] for part in BLOCK_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                if _problem(content) is not None:
                    continue
                header = parse_header(content)
                dtype = block_type(header)
                blocks = np.frombuffer(content, dtype=dtype, offset=header["size"])
                orders = {kind: [] for kind in dtype.names}
                for channel in header["channels"]:
                    if channel["kind"] in orders:
                        orders[channel["kind"]].append(channel["native_order"])
                for chunk, first in enumerate(range(0, len(blocks), blocks_per_chunk)):
                    part = blocks[first : first + blocks_per_chunk]
                    rows = []
                    for kind in dtype.names:
                        # (block, channel, sample) -> one joined run per channel
                        data = part[kind].transpose(1, 0, 2).reshape(part[kind].shape[1], -1)
                        per_block = part[kind].shape[2]
                        for index, values in enumerate(data):
                            order = orders[kind][index] if index < len(orders[kind]) else index
                            rows.append(
                                (
                                    path, kind, index, order, chunk, first * per_block, header["fs"],
                                    header["board_mode"], header["notch"], header["version"][0],
                                    values.astype(np.int32),
                                )
                            )
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, BLOCK_SCHEMA)


def scaled_samples(chunks: DataFrame) -> DataFrame:
    """Decoded analog chunks with ``values`` in physical units."""
    analog = chunks.filter(F.col("kind").isin("amplifier", "aux", "supply", "temperature", "adc"))
    values = F.transform("raw", lambda r: scale_analog(r, F.col("kind"), F.col("board_mode")))
    return analog.withColumn("values", values).drop("raw")


def digital_lines(chunks: DataFrame, channels: DataFrame) -> DataFrame:
    """Digital words unpacked to one Boolean array per line (bit ``native_order``)."""
    lines = channels.filter(F.col("kind").isin("digital_in", "digital_out")).select(
        "path", "kind", F.col("channel").alias("line"), F.col("native_order").alias("bit")
    )
    words = chunks.filter(F.col("kind").isin("digital_in", "digital_out")).drop("channel", "native_order")
    joined = words.join(lines, ["path", "kind"])
    levels = F.transform("raw", lambda w: digital_bit(w, F.col("bit")))
    return joined.withColumn("levels", levels).drop("raw", "bit")

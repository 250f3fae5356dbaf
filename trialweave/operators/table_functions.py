"""Table functions for SQL: epochs and spectra.

    register(spark)
    SELECT * FROM epochs(TABLE(SELECT e.subject, e.trial, c.channel, e.lo, e.hi, c.start_sample, c.values
                               FROM looks e JOIN chunks c USING (subject, chunk)))
    SELECT * FROM spectra(TABLE(SELECT subject, trial, channel, values FROM epoch_arrays), 200.0D, array(10.0D, 20.0D))

Columns that a function does not use are carried, so the result's columns follow the argument's. ``epochs`` deals and
sorts its argument by window and channel itself and holds the samples of one window at a time, never a recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

VALUES = T.ArrayType(T.DoubleType())
BATCH = 64  # rows of one length that go through a kernel together
DEALS = 4096  # hashes of windows; an instance of ``Epochs`` reads the windows of one hash, one after another


def _argument(table: AnalyzeArgument, name: str, needed: tuple[str, ...]) -> T.StructType:
    if not table.isTable:
        raise ValueError(f"{name} wants a table argument")
    missing = [c for c in needed if c not in table.dataType.fieldNames()]
    if missing:
        raise ValueError(f"{name} wants the columns {', '.join(missing)}")
    return table.dataType


class Epochs:
    """Samples ``[lo, hi)`` of every window from the chunks it touches (``start_sample``, ``values``).

    Windows that are not covered are left out; windows that the argument repeats are repeated. Pieces that overlap or
    leave a gap are an error. NULL in ``lo``, ``hi`` or ``start_sample`` or ``values`` leaves the row out.
    """

    USED = ("lo", "hi", "start_sample", "values")

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        fields = _argument(table, "epochs", Epochs.USED)
        kept = [f for f in fields if f.name not in Epochs.USED]
        by = [f"`{c}`" for c in (*[f.name for f in kept], "lo", "hi")]
        return AnalyzeResult(
            schema=T.StructType([*kept, T.StructField("lo", T.LongType()), T.StructField("values", VALUES)]),
            partitionBy=[PartitioningColumn(f"pmod(xxhash64({', '.join(by)}), {DEALS})")],
            orderBy=[*[OrderingColumn(c) for c in by], OrderingColumn("start_sample")],
        )

    def __init__(self):
        self.keys = None
        self._start(None)

    def _start(self, head: list | None) -> None:
        self.head = head
        self.last = None
        self.times = 0
        self.pieces: list[list] = []

    def eval(self, row: T.Row) -> Iterator[tuple]:
        low, high, start, values = row["lo"], row["hi"], row["start_sample"], row["values"]
        if low is None or high is None or start is None or values is None:
            return
        if self.keys is None:
            self.keys = [i for i, c in enumerate(row.__fields__) if c not in self.USED]
        head = [*[row[i] for i in self.keys], low, high]
        if self.head is None or not all(a == b or (a != a and b != b) for a, b in zip(head, self.head)):
            yield from self.terminate()
            self._start(head)
        if self.last is not None and start == self.last[0]:
            self.times += len(self.pieces) == 1  # the window itself is repeated
            return
        piece = values[max(low - start, 0) : max(high - start, 0)]
        if not piece:
            return
        if self.last is not None and start != self.last[1]:
            raise ValueError("chunks of a window do not meet")
        self.times = max(self.times, 1)
        self.last = start, start + len(values)
        self.pieces.append(piece)

    def terminate(self) -> Iterator[tuple]:
        if self.head is not None and self.pieces:
            *keys, low, high = self.head
            whole = [float("nan") if v is None else float(v) for piece in self.pieces for v in piece]
            if len(whole) == high - low:
                for _ in range(self.times):
                    yield (*keys, low, whole)


class Spectra:
    """Multitaper power of every epoch: one row per frequency, ``power`` along time; ``values`` is not kept.

    ``cycles`` of a wavelet are half its frequency. Epochs without values give no rows; NULL samples are an error.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, fs: AnalyzeArgument, freqs: AnalyzeArgument) -> AnalyzeResult:
        fields = _argument(table, "spectra", ("values",))
        if fs.value is None or not freqs.value:
            raise ValueError("spectra wants a constant rate and a constant array of frequencies")
        kept = [f for f in fields if f.name != "values"]
        return AnalyzeResult(
            schema=T.StructType([*kept, T.StructField("freq", T.DoubleType()), T.StructField("power", VALUES)])
        )

    def __init__(self):
        self.held: dict[int, list] = {}
        self.kernel = None

    def eval(self, row: T.Row, fs: float, freqs: list) -> Iterator[tuple]:
        if self.kernel is None:
            from .filters import spectrogram_kernel

            self.freqs = [float(f) for f in freqs]
            self.kernel = spectrogram_kernel(self.freqs, float(fs), [f / 2 for f in self.freqs], 0)
        if not row["values"]:
            return
        group = self.held.setdefault(len(row["values"]), [])
        group.append(([row[c] for c in row.__fields__ if c != "values"], row["values"]))
        if len(group) == BATCH:
            yield from self._powers(self.held.pop(len(row["values"])))

    def _powers(self, group: list) -> Iterator[tuple]:
        x = np.array([v for _, v in group], dtype=float)
        if np.isnan(x).any():
            raise ValueError("an epoch has missing samples")
        power = self.kernel(x).reshape(len(group), len(self.freqs), -1)
        for (keys, _), rows in zip(group, power):
            for f, p in zip(self.freqs, rows):
                yield (*keys, f, p.tolist())

    def terminate(self) -> Iterator[tuple]:
        for group in self.held.values():
            yield from self._powers(group)


def register(spark: SparkSession) -> None:
    """Makes ``epochs`` and ``spectra`` known to the session's SQL."""
    # rows one by one: Arrow would make a table of every call's result
    spark.udtf.register("epochs", F.udtf(Epochs, useArrow=False))
    spark.udtf.register("spectra", F.udtf(Spectra, useArrow=True))


def window_pieces(windows: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """The argument of ``epochs``: each window (subject, ``lo``, ``hi`` and others) with what it needs of the chunks it touches."""
    touched = F.sequence(F.floor(F.col("lo") / F.lit(chunk)), F.floor((F.col("hi") - 1) / F.lit(chunk)))
    looks = windows.filter(F.col("hi") > F.col("lo")).withColumn("chunk", F.explode(touched))
    joined = looks.join(chunks.select("subject", "channel", "chunk", "start_sample", "values"), ["subject", "chunk"])
    begin = F.greatest(F.col("lo") - F.col("start_sample"), F.lit(0)).cast("int")
    count = F.greatest(F.least(F.col("hi") - F.col("start_sample"), F.size("values")).cast("int") - begin, F.lit(0))
    return joined.select(
        *windows.columns, "channel", (F.col("start_sample") + begin).alias("start_sample"),
        F.slice("values", begin + 1, count).alias("values"),
    ).filter(F.size("values") > 0)

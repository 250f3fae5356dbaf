"""Continuous signals: chunk form, re-referencing, outlier channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from ..plans import join_keys, join_measured, measured, neighbours


def to_chunks(rows: DataFrame, keys: Sequence[str], chunk: int, value: str = "value") -> DataFrame:
    """Long samples to one row per ``keys`` and run of ``chunk`` samples.

    A group holds at most ``chunk`` rows, whatever the size of a recording. Missing or repeated
    samples within a chunk are an error, since they would shift all later ones.
    """
    spans = F.element_at("__s", -1)["sample"] - F.element_at("__s", 1)["sample"] + 1
    gap = F.raise_error(F.lit("a chunk has missing or repeated samples"))
    return (
        rows.groupBy(*keys, F.floor(F.col("sample") / F.lit(chunk)).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("sample", value))).alias("__s"))
        .select(
            *keys,
            "chunk",
            F.element_at("__s", 1)["sample"].alias("start_sample"),
            F.when(F.size("__s") == spans, F.transform("__s", lambda s: s[value])).otherwise(gap).alias("values"),
        )
    )


def to_long(chunks: DataFrame) -> DataFrame:
    """Chunk form back to one row per sample."""
    others = [c for c in chunks.columns if c not in ("values", "chunk", "start_sample")]
    return chunks.select(*others, "start_sample", F.posexplode("values").alias("__i", "value")).select(
        *others, (F.col("start_sample") + F.col("__i")).alias("sample"), "value"
    )


def load_microvolts(samples: DataFrame, subjects: Sequence | None = None, value: str = "value") -> DataFrame:
    """Volts to microvolts, trigger channel left out; ``subjects`` prunes the scan.

    A requested subject without any data is an error.
    """
    rows = samples if subjects is None else samples.filter(F.col("subject").isin(list(subjects)))
    if subjects is not None:
        found = {r.subject for r in rows.select("subject").distinct().limit(len(subjects)).collect()}
        missing = [s for s in subjects if s not in found]
        if missing:
            raise ValueError(f"no data found for subjects: {missing}")
    scaled = (
        F.transform(value, lambda v: v * F.lit(1e6))
        if dict(rows.dtypes)[value].startswith("array")
        else F.col(value) * F.lit(1e6)
    )
    return rows.filter(F.col("channel") != "Trigger").withColumn(value, scaled)


def _subtract_reference(chunks: DataFrame, reference: DataFrame, target) -> DataFrame:
    """Subtract the element-wise mean of the ``reference`` rows of each (subject, chunk).

    The mean is one JVM aggregate over vectors with map-side combine, so a row is one
    chunk and not one sample. Channels may differ in length (a recording cut off within a
    chunk): sums are taken per length, of which there is one in nearly all chunks, and a
    sample's mean runs over the channels that reach it.
    """
    sums = reference.groupBy("subject", "chunk", F.size("values").alias("__len")).agg(
        vector_to_array(Summarizer.sum(array_to_vector("values"))).alias("s"),
        F.count(F.lit(1)).alias("n"),
    )
    parts = sums.groupBy("subject", "chunk").agg(
        F.collect_list(F.struct("s", "n")).alias("__parts"), F.max("__len").alias("__len")
    )
    zero = F.lit(0.0)

    def mean_at(i):
        total = F.aggregate("__parts", zero, lambda acc, p: acc + F.coalesce(F.get(p["s"], i), zero))
        count = F.aggregate(
            "__parts", F.lit(0).cast("long"),
            lambda acc, p: acc + F.when(i < F.size(p["s"]), p["n"]).otherwise(F.lit(0)),
        )
        return total / count

    places = F.transform(F.sequence(F.lit(0), F.col("__len") - 1), mean_at)
    single = F.get("__parts", F.lit(0))
    means = parts.select(
        "subject", "chunk",
        F.when(F.size("__parts") == 1, F.transform(single["s"], lambda v: v / single["n"]))
        .otherwise(places)
        .alias("__mean"),
    )
    joined = join_keys(chunks, means, ["subject", "chunk"], "left")
    changed = F.slice(F.zip_with("values", "__mean", lambda v, m: v - m), F.lit(1), F.size("values"))
    return joined.withColumn(
        "values", F.when(target & F.col("__mean").isNotNull(), changed).otherwise(F.col("values"))
    ).drop("__mean")


def reference_average(chunks: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """Common average reference. Bad channels (subject, channel) are left out and left alone."""
    if bad is None:
        return _subtract_reference(chunks, chunks, F.lit(True))
    flags = bad.select("subject", "channel").distinct().withColumn("__bad", F.lit(True))
    flagged = join_measured(chunks, flags, ["subject", "channel"], "left").withColumn(
        "__bad", F.coalesce("__bad", F.lit(False))
    )
    return _subtract_reference(flagged, flagged.filter(~F.col("__bad")), ~F.col("__bad")).drop("__bad")


def reference_white_matter(chunks: DataFrame, channels: DataFrame) -> DataFrame:
    """Mean of the ``pure_white_matter`` channels present, else of ``white_matter`` ones.

    ``channels`` has subject, channel and ``status_description``. The choice is made per
    subject; every channel is referenced.
    """
    present = chunks.select("subject", "channel").distinct()
    grade = (
        F.when(F.col("status_description") == "pure_white_matter", 0)
        .when(F.col("status_description") == "white_matter", 1)
    )
    graded = (
        channels.withColumn("__grade", grade)
        .filter(F.col("__grade").isNotNull())
        .join(present, ["subject", "channel"], "left_semi")
    )
    best = graded.groupBy("subject").agg(F.min("__grade").alias("__grade"))
    chosen = measured(graded.join(best, ["subject", "__grade"], "left_semi").select("subject", "channel").distinct())
    return _subtract_reference(chunks, chunks.join(chosen, ["subject", "channel"], "left_semi"), F.lit(True))


def reference_laplacian(chunks: DataFrame) -> DataFrame:
    """Re-reference along each shaft: ends bipolar, inner contacts minus half their neighbours.

    The window holds the contacts of one shaft in one chunk. Shafts with one contact and
    channels without a shaft name stay as they are.
    """
    shaft, contact = text.shaft_contact(F.col("channel"))
    tagged = chunks.withColumn("__shaft", shaft).withColumn("__contact", contact)
    # channels without a shaft name get a window of their own
    window = Window.partitionBy(
        "subject", "chunk", F.coalesce("__shaft", F.concat(F.lit("\u0000"), "channel"))
    ).orderBy("__contact")
    near = tagged.withColumn("__prev", F.lag("values").over(window)).withColumn(
        "__next", F.lead("values").over(window)
    )

    def referenced(v, i):  # a contact without a neighbour on one side turns bipolar
        before, after = F.get("__prev", i), F.get("__next", i)
        return (
            F.when(before.isNotNull() & after.isNotNull(), v - F.lit(0.5) * (before + after))
            .when(after.isNotNull(), v - after)
            .when(before.isNotNull(), v - before)
            .otherwise(v)
        )

    return near.withColumn("values", F.transform("values", referenced)).drop(
        "__shaft", "__contact", "__prev", "__next"
    )


def set_reference(chunks: DataFrame, scheme: str, bad: DataFrame | None = None, channels: DataFrame | None = None):
    """Re-reference by scheme name: average (CAR), white matter (WM) or Laplacian (LAP)."""
    name = scheme.lower().replace("_", " ")
    if name in ("car", "average", "common average"):
        return reference_average(chunks, bad)
    if name in ("wm", "white matter"):
        return reference_white_matter(chunks, channels)
    if name in ("lap", "laplacian"):
        return reference_laplacian(chunks)
    raise ValueError(f"unknown reference: {scheme}")


def detrend(rows: DataFrame, keys: Sequence[str], index: str = "sample", value: str = "value") -> DataFrame:
    """Least-squares line of ``value`` over ``index`` removed per ``keys``."""
    line = rows.groupBy(*keys).agg(
        F.regr_slope(value, index).alias("__slope"), F.regr_intercept(value, index).alias("__icpt")
    )
    joined = join_measured(rows, line, list(keys))
    return joined.withColumn(
        value, F.col(value) - (F.col("__slope") * F.col(index) + F.col("__icpt"))
    ).drop("__slope", "__icpt")


def channel_outliers(
    rows: DataFrame,
    index: str = "sample",
    subject: Sequence[str] = ("subject",),
    threshold: float = 3.0,
) -> DataFrame:
    """Channels whose spread of squared detrended signal stands out, in two passes.

    Pass one compares all channels of a subject with ``mean + threshold * std``; pass two
    repeats the test among the channels left. Both work on one row per channel.
    """
    keys = [*subject, "channel"]
    square = F.col("value") * F.col("value")
    spread = (
        detrend(rows, keys, index)
        .withColumn("value", F.when(square == 0, F.lit(1e-9)).otherwise(square))
        .groupBy(*keys)
        .agg(F.stddev_pop("value").alias("spread"))
    )

    def limit(of: DataFrame) -> DataFrame:
        return of.groupBy(*subject).agg(
            (F.stddev_pop("spread") * F.lit(threshold) + F.avg("spread")).alias("__limit")
        )

    first = join_keys(spread, limit(spread), list(subject)).select(
        *keys, "spread", (F.col("spread") > F.col("__limit")).alias("__out")
    )
    rest = first.filter(~F.col("__out"))
    second = join_keys(first, limit(rest), list(subject), "left")
    return second.filter(F.col("__out") | (F.col("spread") > F.col("__limit"))).select(*keys, "spread")


def timestamp_gaps(rows: DataFrame, keys: Sequence[str], fs: float, block: int = 128) -> DataFrame:
    """Per recording: number of timestamp steps other than 1, and its time axes.

    ``rows`` holds ``idx`` (0-based sample position) and ``timestamp``. The auxiliary axis
    takes every 4th sample, the supply axis the first sample of every block.
    """
    seen = neighbours(rows, keys, "idx", {"__before": ("timestamp", -1)})
    return seen.groupBy(*keys).agg(
        F.count_if(F.col("timestamp") - F.col("__before") != 1).alias("n_gaps"),
        (F.min("timestamp") / F.lit(float(fs))).alias("t_first"),
        (F.max("timestamp") / F.lit(float(fs))).alias("t_last"),
        F.count_if(F.pmod("idx", F.lit(4)) == 0).alias("n_aux"),
        F.count_if(F.pmod("idx", F.lit(block)) == 0).alias("n_supply"),
    )


def time_axes(rows: DataFrame, keys: Sequence[str], fs: float, block: int = 128) -> DataFrame:
    """Times in seconds of every sample per signal kind.

    ``rows`` holds ``idx`` (0-based sample position) and ``timestamp``. Amplifier, board ADC and digital
    lines have every sample, auxiliary inputs every 4th, supply voltage and temperature the first of
    every block. Result: keys, ``kind``, ``idx`` (position on that axis), ``t``.
    """
    every = {"amplifier": 1, "adc": 1, "digital": 1, "aux": 4, "supply": block, "temperature": block}
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("step")) for k, n in every.items()])
    held = F.filter(kinds, lambda axis: F.pmod(F.col("idx"), axis["step"]) == 0)  # only axes that have the sample
    spread = rows.select(*keys, "idx", "timestamp", F.explode(held).alias("axis"))
    return spread.select(
        *keys, F.col("axis.kind").alias("kind"), F.floor(F.col("idx") / F.col("axis.step")).alias("idx"),
        (F.col("timestamp") / F.lit(float(fs))).alias("t"),
    )


def resolve_rate(recordings: DataFrame, sources: Sequence[str], name: str = "fs") -> DataFrame:
    """First known sampling rate among ``sources``; none known is an error."""
    missing = F.raise_error(F.lit("no sampling rate known for a recording")).cast("double")
    return recordings.withColumn(name, F.coalesce(*sources, missing))

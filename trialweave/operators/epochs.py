"""Epochs: cutting trials from recordings, masks, baseline rescaling, averages, imputation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import hashed_normal
from ..plans import join_measured


def cut_windows(windows: DataFrame, chunks: DataFrame, chunk: int, low: str, high: str) -> DataFrame:
    """Samples ``[low, high)`` of every window from chunked recordings, as ``values``.

    The interval join is an equi-join on (subject, chunk). A window within one chunk is sliced where it meets the chunk
    and moves no further. A window that touches several is copied to each of them; the pieces of equal spans are put
    together once per channel, and the windows take them up. Parts outside the recording are missing from ``values``.
    """
    first, last = F.floor(F.col(low) / F.lit(chunk)), F.floor((F.col(high) - 1) / F.lit(chunk))
    held = chunks.select("subject", "channel", "chunk", "start_sample", "values")
    begin = F.greatest(F.col(low) - F.col("start_sample"), F.lit(0)).cast("int")
    end = F.least(F.col(high) - F.col("start_sample"), F.size("values").cast("long")).cast("int")
    piece = F.slice("values", begin + 1, F.greatest(end - begin, F.lit(0)))
    inside = windows.withColumn("chunk", first).filter(F.col("chunk") == last).join(held, ["subject", "chunk"])
    inside = inside.select(*windows.columns, "channel", piece.alias("values"))

    across = windows.filter(first != last)
    span = ["subject", low, high]
    looks = across.select(*span).distinct().withColumn("chunk", F.explode(F.sequence(first, last)))
    pieces = looks.join(held, ["subject", "chunk"]).select(*span, "channel", F.struct("chunk", piece.alias("v")).alias("__piece"))
    whole = pieces.groupBy(*span, "channel").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("__piece")), lambda p: p["v"])).alias("values")
    )
    return inside.unionByName(across.join(whole, span).select(*windows.columns, "channel", "values"))


def extract_epochs(
    events: DataFrame, chunks: DataFrame, window: tuple[float, float], fs: float, chunk: int
) -> DataFrame:
    """Cut ``[onset + t0, onset + t1]`` around every event, both ends included.

    ``events`` has subject and ``onset`` in seconds; ``chunks`` is the output of
    ``to_chunks`` with the same chunk length. Windows that leave the recording are
    dropped. Result: event columns, channel, ``values``.
    """
    first, last = round(window[0] * fs), round(window[1] * fs)
    length = last - first + 1
    start = F.round(F.col("onset") * F.lit(float(fs))).cast("long") + F.lit(first)
    windows = (
        events.withColumn("__lo", start)
        .withColumn("__hi", start + F.lit(length))
        .filter(F.col("__lo") >= 0)
    )
    whole = cut_windows(windows, chunks, chunk, "__lo", "__hi").drop("__lo", "__hi")
    return whole.filter(F.size("values") == length)


def crop_long(rows: DataFrame, time: str, tmin: float, tmax: float) -> DataFrame:
    """Samples with time in [tmin, tmax]."""
    return rows.filter(F.col(time).between(F.lit(float(tmin)), F.lit(float(tmax))))


def crop_arrays(epochs: DataFrame, t0: float, fs: float, tmin: float, tmax: float) -> DataFrame:
    """The same on array rows that start at ``t0``."""
    first = max(0, math.ceil((tmin - t0) * fs - 1e-9))
    last = math.floor((tmax - t0) * fs + 1e-9)
    return epochs.withColumn("values", F.slice("values", first + 1, max(0, last - first + 1)))


def apply_mask(epochs: DataFrame, mask: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Set the values of trial x channel slices that are not good to NULL."""
    joined = join_measured(epochs, mask.select(*keys, "is_good"), list(keys), "left")
    return joined.withColumn(
        value, F.when(F.coalesce("is_good", F.lit(True)), F.col(value))
    ).drop("is_good")


def expand_mask(phonemes: DataFrame, mask: DataFrame, n_phons: int, keys: Sequence[str]) -> DataFrame:
    """Trial mask repeated for each of its phonemes (``phoneme`` is a 0-based row index)."""
    by = [*keys, "trial"]
    tagged = phonemes.withColumn("trial", F.floor(F.col("phoneme") / F.lit(n_phons)))
    return join_measured(tagged, mask.select(*by, "is_good"), by)


def rescale(
    rows: DataFrame, baseline: DataFrame, keys: Sequence[str], mode: str = "zscore", value: str = "value"
) -> DataFrame:
    """Subtract the baseline mean per ``keys``; ``zscore`` also divides by its deviation.

    Statistics run over all baseline trials and samples, NULL ignored.
    """
    if mode not in ("zscore", "mean"):
        raise ValueError(f"mode must be 'zscore' or 'mean', got {mode!r}")
    stats = baseline.groupBy(*keys).agg(
        F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std")
    )
    joined = join_measured(rows, stats, list(keys))
    centred = F.col(value) - F.col("__mean")
    if mode == "zscore":
        centred = centred / F.nullif(F.col("__std"), F.lit(0.0))
    return joined.withColumn(value, centred).drop("__mean", "__std")


def trial_average(rows: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Mean over trials per channel and time, NULL ignored."""
    return rows.groupBy(*keys, "t").agg(F.avg("value").alias("value"))


def channel_values(rows: DataFrame, keys: Sequence[str] = ("channel",), window=None) -> DataFrame:
    """One value per channel: mean over trials and the time window (ends included)."""
    picked = rows if window is None else rows.filter(F.col("t").between(*window))
    return picked.groupBy(*keys).agg(F.avg("value").alias("value"))


def window_mean(
    rows: DataFrame, first: int, stop: int, keys: Sequence[str] = ("channel", "trial")
) -> DataFrame:
    """Mean per trial and channel over sample indices ``[first, stop)``."""
    return rows.filter((F.col("t") >= first) & (F.col("t") < stop)).groupBy(*keys).agg(
        F.avg("value").alias("value")
    )


def time_as_index(time: float, t0: float, fs: float) -> int:
    """Sample index of a time, truncated toward zero."""
    return int((time - t0) * fs)


def class_average(rows: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Mean vector per class, position by position (columns ``pos``, ``value``)."""
    return (
        rows.select(*keys, F.posexplode(vec).alias("pos", "__v"))
        .groupBy(*keys, "pos")
        .agg(F.avg("__v").alias("value"))
    )


def flatten_features(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ch", "t")
) -> DataFrame:
    """Values of a trial in one vector, ordered by ``order`` (channel-major by default)."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "value")))
    return rows.groupBy(*keys).agg(F.transform(parts, lambda s: s["value"]).alias("vec"))


def impute_by_class(
    epochs: DataFrame,
    keys: Sequence[str] = ("channel",),
    min_trials: int = 2,
    noise: float = 0.0,
    seed: int = 42,
    trial: str = "trial",
) -> DataFrame:
    """Fill trial x channel rows that miss values from the rows of the same class.

    ``epochs`` is in array form. A row with a NULL array or a NULL element is replaced as
    a whole by the class mean over complete rows if the class has ``min_trials`` of them,
    else by the mean over all classes; ``noise`` adds that share of the deviation.
    """
    key_list = list(keys)
    broken = F.col("values").isNull() | F.exists("values", lambda v: v.isNull() | F.isnan(v))
    flagged = epochs.withColumn("__broken", F.coalesce(broken, F.lit(True)))
    donors = flagged.filter(~F.col("__broken")).select(
        *key_list, "label", F.posexplode("values").alias("t", "v")
    )

    def profile(by: list[str], prefix: str) -> DataFrame:
        per_time = donors.groupBy(*by, "t").agg(
            F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("v").alias("n")
        )
        return per_time.groupBy(*by).agg(
            F.array_sort(F.collect_list(F.struct("t", "m", "s"))).alias(f"__{prefix}"),
            F.max("n").alias(f"__{prefix}_n"),
        )

    joined = join_measured(flagged, profile([*key_list, "label"], "class"), [*key_list, "label"], "left")
    joined = join_measured(joined, profile(key_list, "all"), key_list, "left")
    chosen = F.when(F.col("__class_n") >= min_trials, F.col("__class")).otherwise(F.col("__all"))

    def fill(p):
        if noise == 0:
            return p["m"]
        return p["m"] + hashed_normal(seed, *key_list, trial, p["t"]) * F.lit(noise) * p["s"]

    return joined.withColumn(
        "values", F.when(F.col("__broken"), F.transform(chosen, fill)).otherwise(F.col("values"))
    ).select(*epochs.columns)


def impute_by_mean(
    train: DataFrame, rows: DataFrame, keys: Sequence[str] = ("ch", "t"), noise: float = 0.0, seed: int = 42,
    trial: str = "trial",
) -> DataFrame:
    """Fill missing values with the training mean of the same channel and time."""
    fitted = train.groupBy(*keys).agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    joined = join_measured(rows, fitted, list(keys), "left")
    fill = F.col("__m")
    if noise > 0:
        fill = fill + hashed_normal(seed, *keys, trial) * F.lit(noise) * F.col("__s")
    return joined.withColumn("value", F.coalesce("value", fill)).drop("__m", "__s")


def load_subjects(rows: DataFrame, subjects: Sequence, roots: DataFrame, default_root: str) -> DataFrame:
    """Rows of several subjects in one pruned read; the data root depends on the cohort."""
    picked = rows.filter(F.col("subject").isin(list(subjects)))
    joined = join_measured(picked, roots.select("subject", "root"), ["subject"], "left")
    return joined.withColumn("root", F.coalesce("root", F.lit(default_root)))


def features_by_position(rows: DataFrame, position: int, label_type: str = "phon") -> DataFrame:
    """Features of one phoneme position (-1 = all) with the label column of ``label_type``."""
    from ..functions.text import articulator

    if label_type not in ("phon", "artic"):
        raise ValueError(f"label type must be 'phon' or 'artic', got {label_type!r}")
    picked = rows if position == -1 else rows.filter(F.col("position") == position)
    if label_type == "artic":
        picked = picked.withColumn("label", articulator(F.col("label")))
    return picked

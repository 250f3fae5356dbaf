"""Trial quality: good-trial masks and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..plans import join_measured


def good_trials_amplitude(
    rows: DataFrame, threshold: float = 10.0, keys: Sequence[str] = ("channel",)
) -> DataFrame:
    """Good iff the largest magnitude of a trial is below mean + threshold * std and not 0.

    Mean and deviation of the magnitude run over all samples of a channel. Both levels
    combine on the map side, so what is shuffled is one row per trial and channel.
    """
    magnitude = F.abs("value")
    per_trial = rows.groupBy(*keys, "trial").agg(F.max(magnitude).alias("__peak"))
    limits = rows.groupBy(*keys).agg(
        (F.lit(threshold) * F.stddev_pop(magnitude) + F.avg(magnitude)).alias("__limit")
    )
    joined = join_measured(per_trial, limits, list(keys))
    return joined.select(
        *keys, "trial", ((F.col("__peak") < F.col("__limit")) & (F.col("__peak") != 0)).alias("is_good")
    )


def good_trials_step(
    rows: DataFrame, threshold: float, keys: Sequence[str] = ("channel",), signed: bool = False
) -> DataFrame:
    """Good iff the largest step between successive samples of a trial is below threshold.

    The window holds the samples of one trial and channel. ``signed`` looks at upward
    steps only.
    """
    window = Window.partitionBy(*keys, "trial").orderBy("t")
    step = F.col("value") - F.lag("value").over(window)
    steps = rows.withColumn("__step", step if signed else F.abs(step))
    return steps.groupBy(*keys, "trial").agg((F.max("__step") < F.lit(float(threshold))).alias("is_good"))


def good_trial_counts(mask: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Good trials per channel."""
    return mask.groupBy(*keys).agg(F.count_if("is_good").alias("n_good"))


def good_trial_summary(mask: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Smallest, largest and mean number of good trials over channels."""
    return good_trial_counts(mask, keys).agg(
        F.min("n_good").alias("min_good"), F.max("n_good").alias("max_good"), F.avg("n_good").alias("mean_good")
    )


def good_trials_common(
    mask: DataFrame, fraction: float = 0.8, subject: Sequence[str] = ()
) -> DataFrame:
    """Trials that are good on at least ``fraction`` of all channels."""
    channels = mask.select(*subject, "channel").distinct().groupBy(*subject).agg(
        F.count(F.lit(1)).alias("__channels")
    )
    counts = mask.groupBy(*subject, "trial").agg(F.count_if("is_good").alias("n_good"))
    joined = join_measured(counts, channels, list(subject))
    return joined.select(
        *subject, "trial", (F.col("n_good") >= F.lit(float(fraction)) * F.col("__channels")).alias("is_good")
    )

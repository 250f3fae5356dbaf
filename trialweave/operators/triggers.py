"""Trial onsets from a trigger trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..plans import cut_lineage, exact_quantiles, neighbours, number_rows
from ..plans.ordering import join_keys

# --- fixed values -------------------------------------------------------------
BASELINE_QUANTILE = 0.1
MAD_TO_STD = 1.482602218505602  # 1 / normal quantile of 0.75
# ------------------------------------------------------------------------------


def robust_level(trace: DataFrame, keys: Sequence[str], factor: float) -> DataFrame:
    """Per trace: ``baseline`` (10th percentile) and ``threshold`` = baseline + factor * scaled MAD."""
    q = cut_lineage(exact_quantiles(trace, keys, "value", {"baseline": BASELINE_QUANTILE, "__median": 0.5}))
    spread = join_keys(trace.select(*keys, "value"), q.select(*keys, "__median"), list(keys)).select(
        *keys, F.abs(F.col("value") - F.col("__median")).alias("value")
    )
    mad = exact_quantiles(spread, keys, "value", {"__mad": 0.5})
    level = join_keys(q, mad, list(keys)).select(
        *keys, "baseline",
        (F.col("baseline") + F.lit(factor * MAD_TO_STD) * F.col("__mad")).alias("threshold"),
    )
    return cut_lineage(level)  # one row per trace, read by every later step


def local_maxima(trace: DataFrame, keys: Sequence[str], level: DataFrame) -> DataFrame:
    """Peaks of the trace at or above its threshold.

    A peak is a run of equal samples with a lower sample on both sides; its position is
    the middle of the run (rounded down). ``sample`` numbers the trace without gaps.
    Values below the baseline count as the baseline.
    """
    clipped = join_keys(trace, level, list(keys)).withColumn(
        "value", F.greatest("value", "baseline")
    )
    seen = neighbours(clipped, keys, "sample", {"__prev": ("value", -1), "__next": ("value", 1)})
    # only the borders of runs matter: a sample that differs from one of its neighbours
    rises = F.col("__prev") < F.col("value")
    falls = F.col("__next") < F.col("value")
    edges = seen.filter(
        (F.col("value") >= F.col("threshold"))
        & ~((F.col("__prev") == F.col("value")) & (F.col("__next") == F.col("value")))
    ).select(
        *keys, "sample", "value", "threshold",
        F.coalesce(rises, F.lit(False)).alias("__rises"), F.coalesce(falls, F.lit(False)).alias("__falls"),
        (F.coalesce(F.col("__next") == F.col("value"), F.lit(False))).alias("__goes_on"),
    )
    # the edge after a run's first sample is its last one: number the edges, look one ahead
    numbered = number_rows(edges, keys, ["sample"], "__n")
    paired = neighbours(
        numbered, keys, "__n", {"__end": ("sample", 1), "__end_falls": ("__falls", 1)}
    )
    single = F.col("__rises") & F.col("__falls")
    run = F.col("__rises") & F.col("__goes_on") & F.coalesce("__end_falls", F.lit(False))
    return paired.filter(single | run).select(
        *keys,
        F.when(single, F.col("sample")).otherwise(F.floor((F.col("sample") + F.col("__end")) / 2)).alias("sample"),
        F.col("value").alias("height"),
    )


def trigger_candidates(trace: DataFrame, keys: Sequence[str], factor: float = 5.0) -> DataFrame:
    """All local maxima at or above ``baseline + factor * scaled MAD`` of the trace."""
    return local_maxima(trace, keys, robust_level(trace, keys, factor))


def _islands(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Number the runs of consecutive samples in ``rows`` (sample minus row number)."""
    numbered = number_rows(rows, keys, ["sample"], "__n")
    return numbered.withColumn(name, F.col("sample") - F.col("__n")).drop("__n")


def wide_pulses(trace: DataFrame, keys: Sequence[str], level: DataFrame, min_width: int) -> DataFrame:
    """Pulses above the threshold that are at least ``min_width`` samples wide at half height.

    Runs above the threshold are pulses; half height lies midway between a pulse's top and
    the baseline; the width counts the samples of the run around the top that stay above it.
    Result: keys, ``first``, ``last``, ``peak`` (sample of the top).
    """
    raised = join_keys(trace, level, list(keys)).filter(F.col("value") >= F.col("threshold"))
    pulses = _islands(raised.select(*keys, "sample", "value", "baseline"), keys, "__pulse")
    by = [*keys, "__pulse"]
    tops = pulses.groupBy(*by).agg(F.max("value").alias("__top"))
    upper = join_keys(pulses, tops, by).filter(
        F.col("value") >= (F.col("__top") + F.col("baseline")) / 2
    )
    runs = _islands(upper.select(*by, "sample", "value", "__top"), keys, "__run")
    return (
        runs.groupBy(*by, "__top", "__run")
        .agg(
            F.min("sample").alias("first"), F.max("sample").alias("last"),
            F.min(F.when(F.col("value") == F.col("__top"), F.col("sample"))).alias("peak"),
        )
        .filter(F.col("peak").isNotNull() & (F.col("last") - F.col("first") + 1 >= min_width))
        .select(*keys, "first", "last", "peak")
    )


def keep_distant(peaks: DataFrame, keys: Sequence[str], distance: int) -> DataFrame:
    """Greedy by height: a peak removes lower peaks less than ``distance`` samples away.

    Equal heights favour the later peak. Done in rounds: a peak that is the highest of all
    undecided peaks within the distance stays and removes the others around it, which is
    what going through the peaks by falling height does. A round looks at stretches of
    ``distance`` samples with two neighbour stretches on each side, so a window holds at
    most ``5 * distance`` samples of a trace.
    """
    undecided, kept = cut_lineage(peaks.select(*keys, "sample", "height")), []
    while not undecided.isEmpty():
        home = F.floor(F.col("sample") / F.lit(distance))
        spread = undecided.withColumn(
            "__bin", F.explode(F.array(*[home + F.lit(k) for k in (-2, -1, 0, 1, 2)]))
        )
        around = (
            Window.partitionBy(*keys, "__bin").orderBy("sample").rangeBetween(-(distance - 1), distance - 1)
        )
        rank = F.struct("height", "sample")
        flagged = (
            spread.withColumn("__wins", F.max(rank).over(around) == rank)
            .withColumn("__near_winner", F.max("__wins").over(around))
            .filter(F.col("__bin") == home)
            .drop("__bin")
        )
        flagged = cut_lineage(flagged)
        kept.append(flagged.filter("__wins").select(*keys, "sample", "height"))
        undecided = flagged.filter(~F.col("__near_winner")).select(*keys, "sample", "height")
    if not kept:
        return peaks.select(*keys, "sample", "height")
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def trigger_onsets(
    trace: DataFrame,
    keys: Sequence[str],
    fs: float,
    min_dist_s: float = 3.0,
    factor: float = 5.0,
    start_buffer_s: float = 3.0,
    min_width_s: float = 0.5,
    rejection: float = 7.0,
) -> DataFrame:
    """Trial onsets in seconds.

    The last wide pulse plus a buffer starts the task (the trace start if there is none);
    values below the first baseline are raised to it; baseline and noise are taken again from the rest; peaks above the new threshold keep
    a minimum distance; peaks with outlying height are dropped.
    """
    level = robust_level(trace, keys, factor)
    raised = join_keys(trace, level.select(*keys, F.col("baseline").alias("__floor")), list(keys))
    trace = raised.withColumn("value", F.greatest("value", "__floor")).drop("__floor")
    pulses = wide_pulses(trace, keys, level, int(min_width_s * fs))
    begin = cut_lineage(
        pulses.groupBy(*keys).agg((F.max("peak") + F.lit(int(start_buffer_s * fs))).alias("__begin"))
    )
    rest = (
        join_keys(trace, begin, list(keys), "left")
        .filter(F.col("sample") >= F.coalesce("__begin", F.lit(0)))
        .drop("__begin")
    )
    peaks = keep_distant(trigger_candidates(rest, keys, factor), keys, int(min_dist_s * fs))
    stats = peaks.groupBy(*keys).agg(
        F.avg("height").alias("__mean"), F.stddev_pop("height").alias("__std")
    )
    kept = join_keys(peaks, stats, list(keys)).filter(
        F.abs(F.col("height") - F.col("__mean")) <= F.lit(rejection) * F.col("__std")
    )
    return kept.select(*keys, (F.col("sample") / F.lit(float(fs))).alias("onset"), "height")

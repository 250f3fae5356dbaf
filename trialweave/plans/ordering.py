"""Order-dependent computations that never place one whole group in one task.

A plain ``Window.partitionBy(subject).orderBy(onset)`` sends every row of a
subject to one task, which fails when one subject holds a large share of all
rows. The helpers here split groups instead:

* ``number_rows`` / ``running_sum`` range-partition by (group, order), so that a
  large group spans many tasks, and add per-task offsets afterwards;
* ``hashed_rank`` ranks by a uniform hash: hash buckets split every group evenly;
* ``neighbours`` gives lag/lead over a dense row number, in fixed-size chunks that
  carry copies of the few rows around their borders;
* ``exact_quantiles`` interpolates order statistics found by a running count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from .checkpoints import cut_lineage
from .sizing import fits_broadcast, join_measured

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys``, which the data model never leaves NULL.

    Plain equality keeps the partitioning of an aggregate or window on the same keys, so
    its result is joined without another shuffle. Without keys, ``right`` is a one-row
    table of totals and every row gets it.
    """
    if keys:
        return left.join(right, list(keys), how)
    one = F.lit(1)
    single = F.broadcast(right.limit(2).withColumn("__all", one))
    if right.limit(2).count() > 1:
        raise ValueError("without keys the right side must be one row")
    return left.withColumn("__all", one).join(single, "__all", how).drop("__all")


def _place(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Range-partition by (group, order) and tag rows with task and position.

    The result is checkpointed: task borders come from a sample, so both readers
    of the tags (the offsets and the rows) have to see one and the same run.
    """
    keys = [*group, *order]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("__mid", F.monotonically_increasing_id())
        .withColumn("__task", F.shiftright("__mid", _POSITION_BITS))
    )
    return cut_lineage(placed)


def _with_ranks(placed: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """Row numbers of placed rows: position in the task plus the group's rows in earlier tasks."""
    tasks = [*group, "__task"]
    pieces = placed.groupBy(*tasks).agg(
        F.min("__mid").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    # at most (tasks + groups) rows, and at most `tasks` rows of one group
    before = Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        *tasks,
        "__first",
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__earlier"),
    )
    return join_measured(placed, pieces, tasks).withColumn(
        name, F.col("__mid") - F.col("__first") + F.col("__earlier") + F.lit(1)
    ).drop("__first", "__earlier")


def _running(placed: DataFrame, group: Sequence[str], value: str, name: str, fn, merge) -> DataFrame:
    """Running aggregate of placed rows: inside the task, merged with the earlier tasks."""
    tasks = [*group, "__task"]
    before = Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy(*tasks).agg(fn(value).alias("__piece"))
    pieces = pieces.select(*tasks, fn("__piece").over(before).alias("__earlier"))
    inside = Window.partitionBy(*tasks).orderBy("__mid").rowsBetween(Window.unboundedPreceding, 0)
    scanned = placed.withColumn("__inside", fn(value).over(inside))
    return (
        join_measured(scanned, pieces, tasks)
        .withColumn(name, merge(F.col("__inside"), F.col("__earlier")))
        .drop("__inside", "__earlier")
    )


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "rn"
) -> DataFrame:
    """``row_number() over (partition by group order by order)`` as BIGINT.

    ``order`` should be unique within a group; rows that tie are numbered in one
    arbitrary but fixed order.
    """
    return _with_ranks(_place(df, group, order), group, name).drop("__mid", "__task")


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    name: str = "running",
) -> DataFrame:
    """Inclusive running sum of ``value`` within ``group`` in ``order``."""
    zero = F.lit(0)

    def merge(inside: Column, earlier: Column) -> Column:
        return F.coalesce(inside, zero) + F.coalesce(earlier, zero)

    placed = _place(df, group, order)
    return _running(placed, group, value, name, F.sum, merge).drop("__mid", "__task")


def number_and_least(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], rank: str, value: Callable[[], Column], name: str
) -> DataFrame:
    """Row number ``rank`` plus the running minimum ``name`` of an expression that may use it."""
    placed = _with_ranks(_place(df, group, order), group, rank).withColumn("__value", value())
    least = _running(placed, group, "__value", name, F.min, lambda a, e: F.least(a, e))
    return least.drop("__value", "__mid", "__task")


def hashed_rank(
    df: DataFrame,
    group: Sequence[str],
    seed: Column,
    tie: Sequence[str],
    name: str = "rn",
    digits: int = 3,
) -> DataFrame:
    """``row_number() over (partition by group order by md5(seed), tie)``.

    The first ``digits`` hex digits of the hash are a bucket number. Bucket counts
    give the rank of a bucket's first row; the window then runs within (group,
    bucket), with three digits over about 1/4096 of a group. A pure function of the rows, so a re-run
    task gives the same ranks.
    """
    hashed = df.withColumn("__h", F.md5(seed.cast("binary"))).withColumn(
        "__b", F.substring("__h", 1, digits)
    )
    buckets = [*group, "__b"]
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(*buckets).agg(F.count(F.lit(1)).alias("__rows"))
    counts = counts.select(
        *buckets, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*buckets).orderBy("__h", *tie)
    ranked = hashed.withColumn("__inside", F.row_number().over(inside))
    return (
        join_keys(ranked, counts, buckets)
        .withColumn(name, F.col("__before") + F.col("__inside"))
        .drop("__h", "__b", "__before", "__inside")
    )


def neighbours(
    df: DataFrame,
    group: Sequence[str],
    index: str,
    values: dict[str, tuple[str, int]],
    chunk: int = 4096,
) -> DataFrame:
    """Add ``values[name] = (column, offset)``: the column ``offset`` rows away.

    ``index`` numbers the rows of a group without gaps, starting anywhere.
    Negative offsets look back. Rows near a chunk border are copied to the next
    chunk, so a window never spans more than ``chunk`` rows plus those copies.
    """
    back = max([0, *[-off for _, off in values.values()]])
    ahead = max([0, *[off for _, off in values.values()]])
    if chunk <= back + ahead:
        raise ValueError("chunk must be longer than the offsets looked at")
    home = F.floor(F.col(index) / F.lit(chunk))
    inside = F.pmod(F.col(index), F.lit(chunk))
    homes = F.array_compact(
        F.array(
            home,
            F.when(inside < ahead, home - 1),
            F.when(inside >= chunk - back, home + 1),
        )
    )
    spread = df.withColumn("__chunk", F.explode(homes))
    window = Window.partitionBy(*group, "__chunk").orderBy(index)
    for name, (column, offset) in values.items():
        spread = spread.withColumn(name, F.lead(column, offset).over(window))
    return spread.filter(F.col("__chunk") == home).drop("__chunk")


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float], bins: int = 4096
) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per group.

    A histogram with map-side combine locates the few bins that hold the wanted order
    statistics; only the rows of those bins are counted by value and ranked with a running
    count. Result: group columns plus one column per entry of ``probs``.
    """
    keys = list(group)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__x"))
    ends = cut_lineage(
        rows.groupBy(*keys).agg(
            F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count(F.lit(1)).alias("__total")
        )
    )
    small = fits_broadcast(ends)
    if small:
        ends = F.broadcast(ends)
    width = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    place = F.floor((F.col("__x") - F.col("__lo")) / width * F.lit(bins))
    binned = join_keys(rows, ends, keys).withColumn(
        "__bin", F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0))
    )
    order = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy(*keys, "__bin", "__total").agg(F.count(F.lit(1)).alias("__rows_at"))
    counts = counts.withColumn("__lower", F.coalesce(F.sum("__rows_at").over(order), F.lit(0)))

    def position(prob: float) -> Column:
        return F.lit(float(prob)) * (F.col("__total") - 1)

    ranks = [f(position(p)) for p in probs.values() for f in (F.floor, F.ceil)]
    wanted = F.lit(False)
    for rank in ranks:
        wanted = wanted | ((F.col("__lower") <= rank) & (rank < F.col("__lower") + F.col("__rows_at")))
    # at most two bins per quantile and group: small whenever ``ends`` is
    chosen = counts.filter(wanted).select(*keys, "__bin", "__lower")
    if small:
        chosen = F.broadcast(chosen)
    picked = join_keys(binned, chosen, [*keys, "__bin"])
    by_value = picked.groupBy(*keys, "__bin", "__lower", "__total", "__x").agg(
        F.count(F.lit(1)).alias("__rows_at")
    )
    ranked = running_sum(by_value, [*keys, "__bin"], ["__x"], "__rows_at", "__upto")
    first = F.col("__lower") + F.col("__upto") - F.col("__rows_at")
    after = F.col("__lower") + F.col("__upto")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < after), F.col("__x")))

    aggregates = []
    for name, prob in probs.items():
        where = position(prob)
        low, high = at(F.floor(where)), at(F.ceil(where))
        aggregates.append((low + (high - low) * F.max(where - F.floor(where))).alias(name))
    return ranked.groupBy(*keys).agg(*aggregates)

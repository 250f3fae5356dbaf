"""Channel tables: impedance, names, types, layouts, bad-channel sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from ..plans import join_keys, join_measured

NEIGHBOUR_STEPS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def mean_impedance(rows: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Mean impedance of a channel over the files of a recording."""
    return rows.groupBy(*keys).agg(F.avg("impedance").alias("impedance"))


def bad_impedance(rows: DataFrame, threshold: float = 1e6, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Channels whose mean impedance exceeds the threshold."""
    return mean_impedance(rows, keys).filter(F.col("impedance") > F.lit(float(threshold)))


def reflag_impedance(
    channels: DataFrame, rows: DataFrame, threshold: float, keys: Sequence[str] = ("channel",)
) -> DataFrame:
    """Overwrite ``is_bad`` from saved impedances at another threshold."""
    flags = mean_impedance(rows, keys).select(
        *keys, (F.col("impedance") > F.lit(float(threshold))).alias("__bad")
    )
    return (
        join_keys(channels, flags, list(keys), "left")
        .withColumn("is_bad", F.coalesce("__bad", F.lit(False)))
        .drop("__bad")
    )


def channel_names(chanmap: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Name and type of every channel of a map.

    The name is ``R{row}-C{col}`` of the first cell in row-major order; a channel in
    more than one cell is a macro electrode. Empty cells (NULL) carry no channel.
    """
    first = F.min(F.struct("row", "col"))
    return (
        chanmap.filter(F.col("channel_number").isNotNull())
        .groupBy(*keys, "channel_number")
        .agg(first.alias("__at"), F.count(F.lit(1)).alias("__cells"))
        .select(
            *keys,
            "channel_number",
            F.concat(
                F.lit("R"), F.col("__at.row").cast("string"), F.lit("-C"), F.col("__at.col").cast("string")
            ).alias("name"),
            F.when(F.col("__cells") > 1, "macro").otherwise("micro").alias("electrode_type"),
        )
    )


def electrode_types(
    channels: DataFrame, types: DataFrame, keys: Sequence[str] = ("name",), default: str = "micro"
) -> DataFrame:
    """Type of each channel by name, with a default for names not in the map."""
    return join_keys(
        channels, types.select(*keys, "electrode_type"), list(keys), "left"
    ).withColumn("electrode_type", F.coalesce("electrode_type", F.lit(default)))


def rename_channels(channels: DataFrame, names: DataFrame, on: Sequence[str]) -> DataFrame:
    """Replace ``name`` where ``names`` has an entry for the row's position or number."""
    renamed = names.select(*on, F.col("name").alias("__new"))
    return (
        join_keys(channels, renamed, list(on), "left")
        .withColumn("name", F.coalesce("__new", "name"))
        .drop("__new")
    )


def chanmap_table(
    chanmap: DataFrame, names: DataFrame, types: DataFrame, keys: Sequence[str] = ("subject",)
) -> DataFrame:
    """Rows ``row, col, channel_number, name, electrode_type`` of a map.

    A map cell that names a channel outside the recording is an error.
    """
    cells = chanmap.filter(F.col("channel_number").isNotNull()).select(
        *keys, "row", "col", "channel_number"
    )
    by = [*keys, "channel_number"]
    named = join_keys(cells, names.select(*by, "name"), by, "left")
    typed = join_keys(named, types.select(*by, "electrode_type"), by, "left")
    missing = F.raise_error(
        F.concat(F.lit("channel out of range: "), F.col("channel_number").cast("string"))
    )
    return typed.select(
        *keys, "row", "col", "channel_number",
        F.coalesce("name", missing.cast("string")).alias("name"),
        F.coalesce("electrode_type", F.lit("micro")).alias("electrode_type"),
    )


def sorted_map(table: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    return table.orderBy(*keys, "channel_number", "row", "col")


def distinct_channels(chanmap: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Channels of a map once each, empty cells left out, in order."""
    return (
        chanmap.filter(F.col("channel_number").isNotNull())
        .select(*keys, "channel_number")
        .distinct()
        .orderBy(*keys, "channel_number")
    )


def composite_map(base: DataFrame, copies: int, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Stack copies of a map with one empty row between; channel numbers continue per copy.

    The input lists every cell of the base map, empty cells with a NULL channel.
    """
    size = base.groupBy(*keys).agg(
        (F.max("row") + 1).alias("__rows"),
        (F.max("col") + 1).alias("__cols"),
        (F.max("channel_number") + 1).alias("__n"),
    )
    cells = join_measured(base, size.drop("__cols"), list(keys)).withColumn(
        "__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    )
    stacked = cells.select(
        *keys,
        (F.col("row") + F.col("__copy") * (F.col("__rows") + 1)).alias("row"),
        "col",
        (F.col("channel_number") + F.col("__copy") * F.col("__n")).alias("channel_number"),
    )
    if copies < 2:
        return stacked
    gaps = (
        size.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies - 1))))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("__cols") - 1)))
        .select(
            *keys,
            (F.col("__copy") * (F.col("__rows") + 1) - 1).alias("row"),
            "col",
            F.lit(None).cast("int").alias("channel_number"),
        )
    )
    return stacked.unionByName(gaps)


def parse_coordinates(channels: DataFrame) -> DataFrame:
    row, col = text.grid_coordinates(F.col("name"))
    return channels.withColumn("row", row).withColumn("col", col)


def parse_shafts(channels: DataFrame, name: str = "name") -> DataFrame:
    """Shaft and contact of each channel; names of another form are dropped."""
    shaft, contact = text.shaft_contact(F.col(name))
    return channels.withColumn("shaft", shaft).withColumn("contact", contact).filter(
        F.col("shaft").isNotNull()
    )


def dense_contacts(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Renumber the sorted distinct contact numbers of a subject 0..n-1.

    The ranking runs over the distinct numbers, not over the rows.
    """
    distinct = rows.select(*keys, number).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(number)) - 1
    return join_measured(rows, distinct.withColumn("contact_index", rank), [*keys, number])


def grid_neighbors(chanmap: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """The occupied cells among the eight around every occupied cell.

    Each cell is copied to its eight neighbour positions, which turns the lookup into
    an equi-join on (subject, row, col).
    """
    cells = chanmap.filter(F.col("channel_number").isNotNull())
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in NEIGHBOUR_STEPS])
    looks = cells.select(
        *keys, F.col("row").alias("from_row"), F.col("col").alias("from_col"), F.explode(steps).alias("s")
    ).select(
        *keys, "from_row", "from_col",
        (F.col("from_row") + F.col("s.dr")).alias("row"),
        (F.col("from_col") + F.col("s.dc")).alias("col"),
    )
    found = join_keys(looks, cells.select(*keys, "row", "col", "channel_number"), [*keys, "row", "col"])
    return found.select(
        *keys, F.col("from_row").alias("row"), F.col("from_col").alias("col"),
        F.col("row").alias("neighbor_row"), F.col("col").alias("neighbor_col"),
        F.col("channel_number").alias("neighbor_channel"),
    )


def union_bads(lists: Sequence[DataFrame]) -> DataFrame:
    """Union of bad-channel lists, each channel once."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out.distinct()


def shared_bads(reference_bads: DataFrame, derivative_channels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bad channels of the reference recording that exist in the derivative."""
    return reference_bads.join(derivative_channels, list(keys), "left_semi")


def significant_minus_bad(significant: DataFrame, bad: DataFrame, keys: Sequence[str]) -> DataFrame:
    return significant.join(bad, list(keys), "left_anti")


def match_electrodes(used: DataFrame, positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positions of the channels in use, in position order (column ``order``)."""
    return positions.join(used.select(*keys).distinct(), list(keys)).orderBy("order")


def spatial_average(values: DataFrame, chanmap: DataFrame, n: int, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Mean of a per-channel value over n x n blocks of grid cells."""
    by = [*keys, "channel_number"]
    cells = chanmap.filter(F.col("channel_number").isNotNull())
    joined = join_keys(cells, values.select(*by, "value"), by)
    return joined.groupBy(
        *keys,
        F.floor(F.col("row") / F.lit(n)).alias("block_row"),
        F.floor(F.col("col") / F.lit(n)).alias("block_col"),
    ).agg(F.avg("value").alias("value"), F.count("value").alias("n_channels"))

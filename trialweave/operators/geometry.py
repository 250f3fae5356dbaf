"""Electrode geometry: layouts, projection to a template, value scaling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import is_close
from ..plans import cut_lineage, join_keys, join_measured
from . import octree
from .channels import NEIGHBOUR_STEPS


def grid_positions(chanmap: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Synthetic coordinates of occupied cells: cell centres in the unit square, row 0 on top.

    The extent of a map counts its empty cells too.
    """
    size = chanmap.groupBy(*keys).agg(
        (F.max("row") + 1).alias("__rows"), (F.max("col") + 1).alias("__cols")
    )
    cells = join_measured(chanmap.filter(F.col("channel_number").isNotNull()), size, list(keys))
    return cells.select(
        *keys,
        F.concat(F.lit("R"), F.col("row").cast("string"), F.lit("-C"), F.col("col").cast("string")).alias(
            "name"
        ),
        ((F.col("col") + 0.5) / F.col("__cols")).alias("x"),
        ((F.col("__rows") - F.col("row") - 0.5) / F.col("__rows")).alias("y"),
        F.lit(0.0).alias("z"),
    )


def parse_electrodes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Whitespace-separated electrode lines: the first two fields joined are the name."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    return lines.select(
        *[c for c in lines.columns if c != column],
        F.concat(parts.getItem(0), parts.getItem(1)).alias("name"),
        *[parts.getItem(i).cast("double").alias(n) for i, n in ((2, "x"), (3, "y"), (4, "z"))],
    )


def split_hemispheres(electrodes: DataFrame) -> DataFrame:
    """Hemisphere by first letter of the name, else by the sign of x."""
    return electrodes.withColumn(
        "hemi",
        F.when(F.col("name").startswith("L"), "lh")
        .when(F.col("name").startswith("R"), "rh")
        .when(F.col("x") < 0, "lh")
        .otherwise("rh"),
    )


def _scaled(rows: DataFrame, keys: Sequence[str], column, flat, low, high, name: str) -> DataFrame:
    source = rows.withColumn("__v", column)
    ends = source.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    joined = join_measured(source, ends, list(keys))
    unit = (F.col("__v") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    scaled = F.when(is_close(F.col("__lo"), F.col("__hi")), F.lit(flat)).otherwise(
        F.lit(low) + unit * F.lit(high - low)
    )
    return joined.withColumn(name, scaled).drop("__v", "__lo", "__hi")


def minmax_values(rows: DataFrame, keys: Sequence[str], value: str = "value", name: str = "scaled") -> DataFrame:
    """Values scaled to [0, 1] within ``keys``; 0.5 where all are equal."""
    return _scaled(rows, keys, F.col(value), 0.5, 0.0, 1.0, name)


def minmax_sizes(
    rows: DataFrame, keys: Sequence[str], value: str = "value", low: float = 0.2, high: float = 1.5,
    name: str = "size",
) -> DataFrame:
    """Marker sizes from absolute values, scaled into [low, high]."""
    return _scaled(rows, keys, F.abs(F.col(value)), 0.5 * (low + high), low, high, name)


def region_report(values: DataFrame, regions: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """``channel, region, feature_value`` with six decimals as text; missing region = unknown."""
    joined = join_keys(values, regions.select(*keys, "region"), list(keys), "left")
    return joined.select(
        *keys,
        F.coalesce("region", F.lit("unknown")).alias("region"),
        F.regexp_replace(F.format_number("value", 6), ",", "").alias("feature_value"),
    )


def flood_fill(chanmap: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Extend macro electrodes over the empty cells they reach (8-connected).

    Filling macro after macro in channel order gives every connected empty region to
    the lowest macro channel that touches it, so the regions are found first (see
    ``empty_regions``), each takes the minimum of its touching channels, and its cells read it.
    Columns: keys, row, col, channel_number (NULL = empty), is_macro.
    """
    cells = [*keys, "row", "col"]
    regions = empty_regions(chanmap, keys)
    around = _around(
        chanmap.filter(F.col("is_macro") & F.col("channel_number").isNotNull()), keys, ["channel_number"]
    )
    owners = (
        around.join(regions, cells)
        .groupBy(*keys, "region")
        .agg(F.min("channel_number").cast("int").alias("channel_number"))
    )
    filled = join_measured(regions, owners, [*keys, "region"], "left").select(*cells, "channel_number")
    occupied = chanmap.filter(F.col("channel_number").isNotNull()).select(*cells, "channel_number")
    return occupied.unionByName(filled)


def _around(cells: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """The eight cells around each cell, with ``carry`` of the cell in the middle."""
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in NEIGHBOUR_STEPS])
    return cells.select(*keys, "row", "col", *carry, F.explode(steps).alias("__s")).select(
        *keys, (F.col("row") + F.col("__s.dr")).alias("row"), (F.col("col") + F.col("__s.dc")).alias("col"), *carry
    )


def empty_regions(chanmap: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Connected regions of empty cells (8-connected): keys, row, col, ``region``.

    Pointer jumping: every cell points at a lower cell of its region, at first itself. In a round it reads where its
    pointer's pointer and those of the cells around it go; the least of them becomes the pointer of the cell and of
    the cell it pointed at. Distances to the root halve, so rounds grow with the logarithm of the region's size.
    The region is the place of its least cell. Pointers within one region lead to ever fewer cells, whose rows
    Spark splits where a join meets them.
    """
    place = F.struct("row", "col")
    empty = chanmap.filter(F.col("channel_number").isNull()).select(*keys, place.alias("cell")).distinct()
    up = cut_lineage(empty.select("*", F.col("cell").alias("up")))
    flat = up.select(*keys, "cell.row", "cell.col", "cell")
    links = cut_lineage(
        _around(flat, keys, ["cell"]).select(*keys, place.alias("beside"), "cell").join(
            up.select(*keys, F.col("cell").alias("beside")), [*keys, "beside"]
        )
    )
    while True:
        ends = up.select(*keys, F.col("cell").alias("up"), F.col("up").alias("top"))
        tops = cut_lineage(join_keys(up, ends, [*keys, "up"]).select(*keys, "cell", "up", "top"))
        least = (
            links.join(tops.select(*keys, F.col("cell").alias("beside"), "top"), [*keys, "beside"])
            .groupBy(*keys, "cell").agg(F.min("top").alias("least"))
        )
        seen = join_keys(tops, least, [*keys, "cell"], "left").withColumn("least", F.least("top", "least"))
        told = seen.select(*keys, F.explode(F.array("cell", "up")).alias("cell"), "least")
        following = cut_lineage(
            told.groupBy(*keys, "cell").agg(F.min("least").alias("least"))
            .join(tops, [*keys, "cell"])
            .select(*keys, "cell", F.col("least").alias("up"), (F.col("least") != F.col("top")).alias("__moved"))
        )
        up = following.drop("__moved")
        # still once every pointer is a root and no cell beside has a lower one
        if following.filter("__moved").isEmpty():
            return up.select(*keys, "cell.row", "cell.col", F.col("up").alias("region"))


def nearest_vertex(
    points: DataFrame,
    vertices: DataFrame,
    keys: Sequence[str],
    point_id: str,
    vertex_id: str = "vertex",
) -> DataFrame:
    """The vertex nearest to each point within ``keys`` (ties: lowest vertex).

    Exact, without comparing every point with every vertex: the vertices of a key form an octree, and the points
    descend it by branch and bound inside tasks (see ``octree``). Vertices with equal coordinates count once.
    Points with a missing or infinite coordinate get NULL; such vertices are nobody's nearest.
    Result: keys, point id, vertex id, ``distance``.
    """
    xyz = octree.XYZ
    key_list = list(keys)

    def finite() -> Column:
        return reduce(
            lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in xyz]
        )

    whole = vertices.filter(finite()).select(*key_list, vertex_id, *[F.col(c).cast("double").alias(c) for c in xyz])
    distinct = cut_lineage(whole.groupBy(*key_list, *xyz).agg(F.min(vertex_id).alias(vertex_id)))
    vertex_type = vertices.schema[vertex_id].dataType
    known = points.select(*key_list, point_id, *[F.col(c).cast("double").alias(c) for c in xyz]).join(
        distinct.select(*key_list).distinct(), key_list, "left_semi"
    )
    known = cut_lineage(known.withColumn("__placed", F.coalesce(finite(), F.lit(False))))
    # a point with a missing coordinate has no nearest vertex
    nowhere = known.filter("NOT __placed").select(
        *key_list, point_id, F.lit(None).cast(vertex_type).alias(vertex_id), F.lit(None).cast("double").alias("distance")
    )
    if distinct.isEmpty():
        return nowhere
    tree = octree.build(distinct, key_list)
    placed = known.filter("__placed").drop("__placed")
    return octree.nearest(tree, placed, key_list, point_id, vertex_id).unionByName(nowhere)


def project_electrodes(
    electrodes: DataFrame,
    subject_pial: DataFrame,
    subject_sphere: DataFrame,
    template_sphere: DataFrame,
    template_pial: DataFrame,
) -> DataFrame:
    """Electrodes to template space through spherical registration.

    electrode -> nearest vertex of the subject's surface -> same vertex on the subject's
    sphere -> nearest vertex on the template sphere -> that vertex on the template surface.
    Electrodes: subject, hemi, name, x, y, z. Subject surfaces: subject, hemi, vertex, x,
    y, z. Template surfaces: hemi, vertex, x, y, z.
    """
    first = nearest_vertex(electrodes, subject_pial, ["subject", "hemi"], "name")
    on_sphere = first.select("subject", "hemi", "name", "vertex").join(
        subject_sphere, ["subject", "hemi", "vertex"]
    )
    on_sphere = on_sphere.select(
        "hemi", F.struct("subject", "name").alias("point"), "x", "y", "z"
    )
    second = nearest_vertex(on_sphere, template_sphere, ["hemi"], "point")
    return (
        second.select("hemi", "point", "vertex")
        .join(template_pial, ["hemi", "vertex"])
        .select("point.subject", "point.name", "hemi", "vertex", "x", "y", "z")
    )

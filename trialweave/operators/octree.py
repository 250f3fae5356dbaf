"""Octree over points in space and exact nearest neighbours by branch and bound.

The tree of a key is a table with one row per cell and level: a cell is the prefix of a Morton code, and carries the
number of its points and their tight bounds. Cells of at most ``leaf`` points are not split, nor those of level 20,
a millionth of the key's extent: points closer than that share a leaf, whatever their number, and results stay exact.
Keys of very many points have larger leaves, so the cells of a key stay a few MB at any size.

The points of a query are shuffled once, by Morton range. Points next to each other form blocks; a block meets the cells
of its key and descends them in its task, and only its points grouped by leaf go on to the vertices of the leaves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans import cut_lineage

DEPTH = 20  # 60 bits of Morton code
XYZ = ["x", "y", "z"]
LEAVES = 4096  # a cell is split while it holds more than this share of its key's points
PART = 4096  # vertices of a leaf that stand in one row
PAIRS = 1 << 20  # points times cells, or times vertices, that a task compares at once
SLACK = 1.0 + 1e-9  # rounding never leaves a cell out


@dataclass(frozen=True)
class Octree:
    """``cells``: keys, level, code, n and bounds; ``points``: keys, level and code of the leaf, id, coordinates.

    ``cubes`` are the keys' extents; ``counts`` holds the number of cells of each level.
    """

    cells: DataFrame
    points: DataFrame
    cubes: DataFrame
    counts: dict[int, int]
    leaf: int


def _prefix(level: Column | int) -> Column:
    """The cell of a point at a level."""
    level = level if isinstance(level, Column) else F.lit(level)
    return F.call_function("shiftright", F.col("__code"), (F.lit(DEPTH) - level) * 3)


def _cubes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cube that holds all points of a key: lower corner, edge, and the number of points."""
    return points.groupBy(*keys).agg(
        *[F.min(c).alias(f"__0{c}") for c in XYZ],
        F.greatest(*[F.max(c) - F.min(c) for c in XYZ]).alias("__edge"), F.count(F.lit(1)).alias("__n"),
    )


def _coded(points: DataFrame, cubes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the Morton code within the cube of the key, of the nearest place inside it for points outside, and ``__n``."""
    boxed = points.join(cubes, list(keys))
    last = 2**DEPTH - 1
    for c in XYZ:
        share = (F.col(c) - F.col(f"__0{c}")) / F.nullif(F.col("__edge"), F.lit(0.0))
        inside = F.greatest(F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        boxed = boxed.withColumn(f"__i{c}", F.least(F.floor(inside * 2**DEPTH), F.lit(last)).cast("bigint"))
    bits = " | ".join(f"shiftleft(shiftright(__i{c}, i) & 1L, 3 * i + {o})" for c, o in zip(XYZ, (2, 1, 0)))
    code = F.expr(f"aggregate(sequence(0, {DEPTH - 1}), 0L, (a, i) -> a | {bits})")
    return boxed.withColumn("__code", code).select(*points.columns, "__code", "__n")


def build(points: DataFrame, keys: Sequence[str], leaf: int = 32, stride: int = 4) -> Octree:
    """Octree of each key's points (columns: keys, ``x, y, z`` and any others; no two points of a key alike).

    ``stride`` levels are built at a time, from the points whose cells are still too large, so evenly spread points are
    read once for every ``stride`` levels, and only clusters go deeper. Coordinates are finite. A key of more than
    ``leaf * LEAVES`` points has leaves of up to a ``LEAVES``-th of them.
    """
    from ..plans.sizing import measured

    keys = list(keys)
    cell = [*keys, "level", "code"]
    cubes = measured(_cubes(points, keys))
    pending = cut_lineage(_coded(points, cubes, keys))
    most = F.greatest(F.lit(leaf), F.ceil(F.col("__n") / LEAVES))
    columns = points.columns
    cells, members, low = [], [], 0
    while True:
        high = min(low + stride - 1, DEPTH)
        spread = pending.withColumn("level", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(
            "code", _prefix(F.col("level"))
        )
        counted = cut_lineage(
            spread.groupBy(*cell).agg(
                F.count(F.lit(1)).alias("n"), F.any_value(most).alias("__most"),
                *[F.min(c).alias(f"{c}0") for c in XYZ], *[F.max(c).alias(f"{c}1") for c in XYZ],
            )
        )
        large = counted.filter((F.col("n") > F.col("__most")) & (F.col("level") < DEPTH)).select(*cell)
        parents = large.select(*keys, (F.col("level") + 1).alias("level"), F.col("code").alias("__parent"))
        up = F.shiftright("code", 3)
        tree = counted.filter(F.col("level") == low).unionByName(
            counted.filter(F.col("level") > low).withColumn("__parent", up).join(
                parents, [*keys, "level", "__parent"], "left_semi"
            ).drop("__parent")
        )
        tree = cut_lineage(tree.withColumn("is_leaf", (F.col("n") <= F.col("__most")) | (F.col("level") == DEPTH)).drop("__most"))
        cells.append(tree)
        members.append(cut_lineage(
            spread.join(tree.filter("is_leaf").select(*cell), cell, "left_semi").select(*cell, *[c for c in columns if c not in keys])
        ))
        open_cells = tree.filter(~F.col("is_leaf") & (F.col("level") == high)).select(*keys, F.col("code").alias("__cell"))
        if high == DEPTH or open_cells.isEmpty():
            break
        pending = cut_lineage(
            pending.withColumn("__cell", _prefix(high)).join(open_cells, [*keys, "__cell"], "left_semi").drop("__cell")
        )
        low = high + 1
    union = lambda a, b: a.unionByName(b)
    every = reduce(union, cells)
    counts = {r.level: r["count"] for r in every.groupBy("level").count().collect()}  # one row a level
    return Octree(every, reduce(union, members), cubes, counts, leaf)


def _bounds(xyz: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared least distance to a cell's points, and one within which a point surely lies.

    Every face of tight bounds holds a point: along one axis that is the nearer face, the farther along the others.
    """
    to_low, to_high = xyz - low, high - xyz
    gap = np.maximum(np.maximum(-to_low, -to_high), 0.0)
    to_low, to_high = np.abs(to_low), np.abs(to_high)
    near, far = np.minimum(to_low, to_high) ** 2, np.maximum(to_low, to_high) ** 2
    sure = np.minimum(
        np.minimum(near[:, 0] + far[:, 1] + far[:, 2], far[:, 0] + near[:, 1] + far[:, 2]),
        far[:, 0] + far[:, 1] + near[:, 2],
    )
    return (gap * gap).sum(axis=1), sure


def _columns(structs: pa.StructArray, names: Sequence[str]) -> np.ndarray:
    return np.stack([structs.field(n).to_numpy(zero_copy_only=False) for n in names], axis=1)


def _met(cells: pa.StructArray, xyz: np.ndarray):
    """(point, cell) arrays of the leaves that may hold each point's nearest neighbour; cells in order of level and code."""
    level, code, is_leaf = (cells.field(n).to_numpy(zero_copy_only=False) for n in ("level", "code", "is_leaf"))
    low, high = (_columns(cells, [f"{c}{e}" for c in XYZ]) for e in (0, 1))
    first, last = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    at = np.searchsorted(level, np.arange(level[-1] + 2))
    for i, j, k in zip(at[:-2], at[1:-1], at[2:]):
        first[i:j] = j + np.searchsorted(code[j:k], code[i:j] << 3)
        last[i:j] = j + np.searchsorted(code[j:k], (code[i:j] + 1) << 3)
    todo = [np.arange(len(xyz))]
    while todo:
        points = todo.pop()
        own, cell, least = np.arange(len(points)), np.zeros(len(points), np.int64), np.zeros(len(points))
        sure, found = np.full(len(points), np.inf), []
        while True:
            done = is_leaf[cell]
            found.append((own[done], cell[done], least[done]))
            own, cell = own[~done], cell[~done]
            many = last[cell] - first[cell]
            total = int(many.sum())
            if not total or (total > PAIRS and len(points) > 1):
                break
            own = np.repeat(own, many)
            cell = np.repeat(first[cell] - (np.cumsum(many) - many), many) + np.arange(total)
            least, reach = _bounds(xyz[points[own]], low[cell], high[cell])
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sure[own[start]] = np.minimum(sure[own[start]], np.minimum.reduceat(reach, start))
            near = least <= sure[own] * SLACK
            own, cell, least = own[near], cell[near], least[near]
        if total:  # too many for one go
            todo += np.array_split(points, 2)
            continue
        own, cell, least = (np.concatenate(x) for x in zip(*found))
        near = least <= sure[own] * SLACK
        yield points[own[near]], cell[near]


def _grouped(tree: Octree, points: DataFrame, keys: Sequence[str], point_id: str) -> DataFrame:
    """Points by leaves that may hold their nearest neighbour: keys, ``level``, ``code``, ``members`` (id, coordinates).

    The points of a leaf stand in as many rows as blocks of points hold some.
    """
    from ..plans.sizing import join_measured

    width = len(keys)
    kinds = [T.StructField(k, points.schema[k].dataType) for k in keys]
    member = T.ArrayType(T.StructType([T.StructField("id", points.schema[point_id].dataType)]
                                      + [T.StructField(c, T.DoubleType()) for c in XYZ]))
    block = T.StructType([*kinds, T.StructField("members", member)])
    laid = _coded(points.select(*keys, point_id, *XYZ), tree.cubes, keys)
    order = [*keys, "__code", F.xxhash64(point_id)]  # equal places spread over tasks too
    laid = laid.repartitionByRange(*order).sortWithinPartitions(*keys, "__code").select(*keys, point_id, *XYZ)

    def blocks(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.zeros(n, bool)
            fresh[0] = True
            for i in range(width):
                codes = batch.column(i).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                fresh[1:] |= codes[1:] != codes[:-1]
            start = np.flatnonzero(fresh)
            rows = pa.StructArray.from_arrays([batch.column(i) for i in range(width, width + 4)], names=["id", *XYZ])
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, n), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(pa.array(start)) for i in range(width)], lists], names=[*keys, "members"]
            )

    bounds = [f"{c}{e}" for c in XYZ for e in (0, 1)]
    trees = tree.cells.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("level", "code", "is_leaf", *bounds))).alias("cells")
    )
    met = join_measured(laid.mapInArrow(blocks, block), trees, keys).select(*keys, "members", "cells")

    def run(batches):
        for batch in batches:
            members, trees = batch.column(width), batch.column(width + 1)
            for r in range(batch.num_rows):
                rows, cells = members[r].values, trees[r].values
                for own, cell in _met(cells, _columns(rows, XYZ)):
                    order = np.argsort(cell, kind="stable")
                    own, cell = own[order], cell[order]
                    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(cell)), pa.int32()), rows.take(pa.array(own)))
                    leaves = pa.array(cell[start])
                    key = pa.array(np.full(len(start), r))
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(i).take(key) for i in range(width)], cells.field("level").take(leaves),
                         cells.field("code").take(leaves), lists],
                        names=[*keys, "level", "code", "members"],
                    )

    place = [T.StructField("level", T.IntegerType()), T.StructField("code", T.LongType())]
    return met.mapInArrow(run, T.StructType([*kinds, *place, T.StructField("members", member)]))


def descend(tree: Octree, points: DataFrame, keys: Sequence[str], point_id: str) -> DataFrame:
    """Leaves that may hold each point's nearest neighbour: keys, id, coordinates, ``level``, ``code``.

    Points go down the tree level by level inside tasks; cells farther away than a neighbour that surely exists are
    left out.
    """
    keys = list(keys)
    looks = _grouped(tree, points, keys, point_id).select(*keys, "level", "code", F.explode("members").alias("__m"))
    return looks.select(*keys, F.col("__m.id").alias(point_id), *[F.col(f"__m.{c}") for c in XYZ], "level", "code")


def nearest(tree: Octree, points: DataFrame, keys: Sequence[str], point_id: str, vertex_id: str) -> DataFrame:
    """The nearest point of the tree, ties to the lowest id: keys, point id, vertex id, ``distance``."""
    from ..plans.sizing import join_measured

    keys = list(keys)
    width = len(keys)
    cell = [*keys, "level", "code"]
    # a leaf of the last level may hold any number of vertices
    sizes = tree.cells.filter(F.col("is_leaf") & (F.col("n") > PART)).select(*cell, "n")
    held = join_measured(tree.points.select(*cell, vertex_id, *XYZ), sizes, cell, "left").withColumn(
        "__part", F.pmod(F.xxhash64(vertex_id), F.coalesce(F.ceil(F.col("n") / PART), F.lit(1)))
    )
    leaves = held.groupBy(*cell, "__part").agg(
        F.sort_array(F.collect_list(F.struct(F.col(vertex_id).alias("id"), *XYZ))).alias("vertices")
    ).drop("__part")
    met = join_measured(_grouped(tree, points, keys, point_id), leaves, cell).select(*keys, "members", "vertices")

    def run(batches):
        for batch in batches:
            members, leaves = batch.column(width), batch.column(width + 1)
            out = []
            for r in range(batch.num_rows):
                rows, vertices = members[r].values, leaves[r].values
                p, v = _columns(rows, XYZ), _columns(vertices, XYZ)
                step = max(1, PAIRS // len(v))
                best, square = np.empty(len(p), np.int64), np.empty(len(p))
                for i in range(0, len(p), step):
                    part = p[i : i + step, None]
                    d2 = (part[..., 0] - v[:, 0]) ** 2 + (part[..., 1] - v[:, 1]) ** 2 + (part[..., 2] - v[:, 2]) ** 2
                    best[i : i + step] = d2.argmin(axis=1)
                    square[i : i + step] = d2[np.arange(len(part)), best[i : i + step]]
                out.append((rows.field("id"), square, vertices.field("id").take(pa.array(best))))
            if not out:
                continue
            ids, square, best = zip(*out)
            key = pa.array(np.repeat(np.arange(len(out)), [len(x) for x in square]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(key) for i in range(width)], pa.concat_arrays(ids), pa.array(np.concatenate(square)),
                 pa.concat_arrays(best)],
                names=[*keys, point_id, "__d2", "__v"],
            )

    kinds = [T.StructField(c, points.schema[c].dataType) for c in [*keys, point_id]]
    kinds += [T.StructField("__d2", T.DoubleType()), T.StructField("__v", tree.points.schema[vertex_id].dataType)]
    best = met.mapInArrow(run, T.StructType(kinds)).groupBy(*keys, point_id).agg(F.min(F.struct("__d2", "__v")).alias("__best"))
    return best.select(*keys, point_id, F.col("__best.__v").alias(vertex_id), F.sqrt("__best.__d2").alias("distance"))

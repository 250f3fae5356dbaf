"""Octree search and regions of empty cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.operators import geometry as geo, octree
from trialweave.plans import cut_lineage

PLACE = "hemi string, {} long, x double, y double, z double"


def table(spark, xyz, name, hemi="lh"):
    return spark.createDataFrame([(hemi, i, *map(float, x)) for i, x in enumerate(xyz)], PLACE.format(name))


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(5)
    # a sphere, a cluster 1/20 000 as wide, a line, and points of both kinds and far off
    sphere = rng.normal(size=(1500, 3))
    sphere *= 50 / np.linalg.norm(sphere, axis=1, keepdims=True)
    cluster = np.array([50.0, 0, 0]) + rng.normal(size=(300, 3)) * 2e-3
    line = np.c_[np.arange(200) * 0.5, np.zeros(200), np.zeros(200)]
    vertices = np.vstack([sphere, cluster, line])
    points = np.vstack([
        rng.normal(size=(40, 3)) * 40, np.array([50.0, 0, 0]) + rng.normal(size=(20, 3)) * 2e-3,
        [[1e6, -1e6, 3.0], [-4e3, 0.0, 0.0], [10.25, 0.0, 0.0]],
    ])
    return vertices, points


def test_tree_holds_every_point_once_in_leaves_of_bounded_size(spark, clouds):
    vertices, _ = clouds
    tree = octree.build(cut_lineage(table(spark, vertices, "vertex")), ["hemi"], leaf=16)
    held = tree.points.groupBy("level", "code").count().collect()
    assert sum(r["count"] for r in held) == len(vertices)
    assert max(r["count"] for r in held) <= 16
    leaves = {(r.level, r.code): r.n for r in tree.cells.filter("is_leaf").collect()}
    assert leaves == {(r.level, r.code): r["count"] for r in held}
    assert max(tree.counts) <= octree.DEPTH


def test_nearest_equals_all_pairs_and_meets_few(spark, clouds):
    vertices, points = clouds
    v, p = table(spark, vertices, "vertex"), table(spark, points, "name")
    d = ((points[:, None] - vertices[None]) ** 2).sum(axis=2)
    got = {r.name: (r.vertex, r.distance) for r in geo.nearest_vertex(p, v, ["hemi"], "name").collect()}
    assert {k: a for k, (a, _) in got.items()} == {i: int(d[i].argmin()) for i in range(len(points))}
    assert np.allclose([got[i][1] for i in range(len(points))], np.sqrt(d.min(axis=1)))
    tree = octree.build(cut_lineage(v), ["hemi"], leaf=16)
    met = octree.descend(tree, p, ["hemi"], "name").join(tree.points, ["hemi", "level", "code"]).groupBy("name").count()
    assert met.agg(F.max("count")).first()[0] < len(vertices) // 8


def test_points_are_shuffled_once_whatever_the_depth(spark, clouds, monkeypatch):
    vertices, points = clouds
    tree = octree.build(cut_lineage(table(spark, vertices, "vertex")), ["hemi"], leaf=16)
    assert max(tree.counts) >= 8
    rounds = []
    monkeypatch.setattr(octree, "cut_lineage", lambda df: rounds.append(1) or cut_lineage(df))
    plan = octree.descend(tree, table(spark, points, "name"), ["hemi"], "name")._jdf.queryExecution().executedPlan().toString()
    assert not rounds
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan


def test_points_equally_far_from_all_and_leaves_of_many_vertices(spark):
    rng = np.random.default_rng(3)
    sphere = rng.normal(size=(1500, 3))
    sphere *= 50 / np.linalg.norm(sphere, axis=1, keepdims=True)
    vertices = np.vstack([sphere, [50.0, 50.0, 50.0] + rng.normal(size=(5000, 3)) * 1e-6])
    points = np.vstack([rng.normal(size=(8000, 3)) * 1e-3, [50.0, 50.0, 50.0] + rng.normal(size=(20, 3)) * 1e-6])
    best = np.concatenate([((p[:, None] - vertices[None]) ** 2).sum(axis=2).argmin(axis=1) for p in np.array_split(points, 40)])
    out = geo.nearest_vertex(table(spark, points, "name"), table(spark, vertices, "vertex"), ["hemi"], "name").collect()
    assert {r.name: r.vertex for r in out} == dict(enumerate(best.tolist()))


def test_points_closer_than_the_finest_cell_share_a_leaf(spark):
    rng = np.random.default_rng(9)
    vertices = np.vstack([rng.normal(size=(80, 3)) * 1e-9, [[100.0, 100.0, 100.0]]])
    points = np.vstack([rng.normal(size=(10, 3)) * 1e-9, [[90.0, 100.0, 100.0]]])
    d = ((points[:, None] - vertices[None]) ** 2).sum(axis=2)
    out = geo.nearest_vertex(table(spark, points, "name"), table(spark, vertices, "vertex"), ["hemi"], "name").collect()
    assert {r.name: r.vertex for r in out} == {i: int(d[i].argmin()) for i in range(len(points))}


def test_keys_have_trees_of_their_own_and_ties_go_to_the_lowest(spark):
    left = table(spark, [[0, 0, 0], [2, 0, 0], [2, 0, 0], [-2, 0, 0]], "vertex")
    right = table(spark, [[1e5, 1e5, 1e5]], "vertex", "rh")
    points = table(spark, [[1, 0, 0], [1.5, 0, 0]], "name").unionByName(table(spark, [[0, 0, 0]], "name", "rh"))
    nobody = table(spark, [[0, 0, 0]], "name", "none")
    out = geo.nearest_vertex(points.unionByName(nobody), left.unionByName(right), ["hemi"], "name").collect()
    assert {(r.hemi, r.name): r.vertex for r in out} == {("lh", 0): 0, ("lh", 1): 1, ("rh", 0): 0}
    assert geo.nearest_vertex(points, left.limit(0), ["hemi"], "name").count() == 0


def grid(spark, rows):
    return spark.createDataFrame(
        [("s", r, c, None if v in (None, 0) else abs(v), bool(v and v < 0)) for r, row in enumerate(rows) for c, v in enumerate(row)],
        "subject string, row int, col int, channel_number int, is_macro boolean",
    )


def regions_by_hand(rows):
    empty = {(r, c) for r, row in enumerate(rows) for c, v in enumerate(row) if not v}
    out = {}
    for start in sorted(empty):
        todo = [start] if start not in out else []
        while todo:
            r, c = todo.pop()
            if (r, c) in empty and (r, c) not in out:
                out[(r, c)] = start
                todo += [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


@pytest.mark.parametrize("share", [0.3, 0.55, 0.8])
def test_regions_equal_a_search_cell_by_cell(spark, share):
    rng = np.random.default_rng(int(share * 100))
    rows = [[1000 + 30 * r + c if rng.random() < share else None for c in range(30)] for r in range(20)]
    got = {(r.row, r.col): tuple(r.region) for r in geo.empty_regions(grid(spark, rows)).collect()}
    assert got == regions_by_hand(rows)


def test_a_long_corridor_takes_rounds_of_its_logarithm(spark, monkeypatch):
    # walls between the lanes of a winding corridor of about 800 cells; negative numbers mark macros
    rows = [[None if r % 2 == 0 or c == (24 if r % 4 == 1 else 0) else 100 + r for c in range(25)] for r in range(61)]
    rows[60][24] = -7
    rows[0][0] = -9
    rounds = []
    monkeypatch.setattr(geo, "cut_lineage", lambda df: rounds.append(1) or cut_lineage(df))
    got = {(r.row, r.col): r.channel_number for r in geo.flood_fill(grid(spark, rows)).collect()}
    assert {got[k] for k in regions_by_hand(rows)} == {7}
    assert (len(rounds) - 2) / 2 <= 20


def test_a_grid_without_empty_cells_or_macros(spark):
    full = geo.flood_fill(grid(spark, [[1, 2], [3, -4]]))
    assert sorted(r.channel_number for r in full.collect()) == [1, 2, 3, 4]
    bare = geo.flood_fill(grid(spark, [[1, None]]))
    assert {r.channel_number for r in bare.collect()} == {1, None}

"""Joint reduction of several subjects: multi-set canonical correlation and stacked principal axes.

The subjects' vectors are aligned row by row (same label and time, or also same rank of the trial within its label) and
stood side by side; all that a joint fit needs is the Gram matrix of the joined vectors, which tasks add up over the
rows they hold and which travels in tiles. One task solves one key, from a matrix whose order is the number of channels
of all subjects; rows, trials and time steps do not count towards that. Sums are additive, so the training set of a fold
is the total without it, and rows are read once per iteration instead of once per fold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans import join_keys
from ..plans.blocks import gram_tiles, whole_gram
from . import stats as st

Solver = Callable[[np.ndarray, list[int]], tuple[list[np.ndarray], np.ndarray]]


def _blocks(dims: list[int]) -> list[slice]:
    ends = np.cumsum(dims)
    return [slice(int(e - d), int(e)) for e, d in zip(ends, dims)]


def _turned(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Signs such that the largest entry of a component over all sets is positive."""
    joined = np.vstack(matrices)
    lead = np.sign(joined[np.abs(joined).argmax(axis=0), np.arange(joined.shape[1])])
    return [m * np.where(lead == 0, 1, lead) for m in matrices]


def mcca(n_comp: int = 10, reg: float = 0.5) -> Solver:
    """Multi-set canonical correlation: ``C v = eigen D v``.

    ``C`` is the scatter matrix of the joined, centred vectors; ``D`` has the sets' own scatter matrices ``S`` on its
    diagonal as ``(1 - reg) S + reg I``. Directions without variance are left out. With two sets and ``reg`` 0,
    ``eigen - 1`` are the canonical correlations. Vectors are scaled so that ``v' D v`` is 1.
    """

    def solve(scatter: np.ndarray, dims: list[int]):
        whiteners = []
        for block in _blocks(dims):
            own = scatter[block, block]
            values, vectors = np.linalg.eigh((1 - reg) * (own + own.T) / 2 + reg * np.eye(len(own)))
            keep = values > max(values.max(initial=0.0), 0.0) * 1e-10
            whiteners.append(vectors[:, keep] / np.sqrt(values[keep]))
        wide = np.zeros((len(scatter), sum(w.shape[1] for w in whiteners)))
        for block, columns, w in zip(_blocks(dims), _blocks([w.shape[1] for w in whiteners]), whiteners):
            wide[block, columns] = w
        values, vectors = np.linalg.eigh(wide.T @ scatter @ wide)
        k = min(n_comp, len(values))
        directions = wide @ vectors[:, ::-1][:, :k]
        return _turned([directions[block] for block in _blocks(dims)]), values[::-1][:k]

    return solve


def joint_axes(n_comp: float = 0.8, ridge: float = 1e-9) -> Solver:
    """Stacked principal axes: the components of the joined vectors, and per set the least-squares map on to them.

    ``n_comp`` below 1 is a share of the joint variance. A set's map gives its best estimate of the joint scores from its
    own channels alone; ``ridge`` is relative to the set's largest eigenvalue.
    """

    def solve(scatter: np.ndarray, dims: list[int]):
        values, vectors = np.linalg.eigh((scatter + scatter.T) / 2)
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
        if n_comp < 1:
            share = np.cumsum(values) / max(values.sum(), 1e-300)
            k = min(int(np.searchsorted(share, n_comp, side="right")) + 1, len(values))
        else:
            k = min(int(n_comp), len(values))
        axes = vectors[:, :k]
        maps = []
        for block in _blocks(dims):
            own = scatter[block, block]
            least = ridge * max(np.linalg.eigvalsh((own + own.T) / 2)[-1], 1e-300)
            maps.append(np.linalg.solve(own + least * np.eye(len(own)), scatter[block] @ axes))
        return _turned(maps), values[:k]

    return solve


def join_sets(rows: DataFrame, keys: Sequence[str], at: Sequence[str], sets: str = "subject") -> tuple[DataFrame, DataFrame]:
    """(joined vectors, layout): vectors of all sets side by side where every set has the row ``at``.

    ``rows``: keys, set, ``at``, vec; a set has one row per ``at`` and one vector length per key. The layout is a short
    list per key: ``sets`` in ascending order and their ``dims``.
    """
    lengths = rows.groupBy(*keys, sets).agg(F.max(F.size("vec")).alias("__d"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(sets).cast("string").alias("s"), F.col("__d").alias("d"))))
    layout = lengths.groupBy(*keys).agg(listed.alias("__l"))
    layout = layout.select(*keys, F.col("__l.s").alias("sets"), F.col("__l.d").alias("dims"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(sets).cast("string").alias("s"), "vec")))
    grouped = rows.groupBy(*keys, *at).agg(parts.alias("__p"))
    whole = join_keys(grouped, layout, list(keys)).filter(F.size("__p") == F.size("sets"))
    return whole.select(*keys, *at, F.flatten(F.transform("__p", lambda s: s["vec"])).alias("vec")), layout


def solve_sets(tiles: DataFrame, layout: DataFrame, keys: Sequence[str], solver: Solver) -> DataFrame:
    """One linear map per key and set: keys, ``set``, ``mean``, ``matrix`` (row-major), ``eigen``."""
    types = {f.name: f.dataType.simpleString() for f in tiles.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", `set` string, mean array<double>, matrix array<double>, eigen array<double>"

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        dims = [int(d) for d in frame["dims"].iloc[0]]
        gram = whole_gram(frame, 1 + sum(dims))
        n, total = gram[0, 0], gram[0, 1:]
        matrices, eigen = solver(gram[1:, 1:] - np.outer(total, total) / n, dims)
        rows = [
            (*[frame[k].iloc[0] for k in keys], name, total[block] / n, matrix.ravel(), eigen)
            for name, block, matrix in zip(frame["sets"].iloc[0], _blocks(dims), matrices)
        ]
        return pd.DataFrame(rows, columns=[*keys, "set", "mean", "matrix", "eigen"])

    return join_keys(tiles, layout, list(keys)).groupBy(*keys).applyInPandas(solve, schema)


def fit_sets(rows: DataFrame, keys: Sequence[str], at: Sequence[str], solver: Solver, sets: str = "subject") -> DataFrame:
    """Joint fit of the sets of each key (at least one key); see ``join_sets`` and ``solve_sets``."""
    joined, layout = join_sets(rows, keys, at, sets)
    return solve_sets(gram_tiles(joined, keys, "vec"), layout, keys, solver)


def variates(rows: DataFrame, maps: DataFrame, keys: Sequence[str], sets: str = "subject") -> DataFrame:
    """Rows in the joint space: ``vec`` becomes ``(vec - mean) matrix`` of the row's key and set.

    The maps are one short row per key and set; AQE splits a hot set.
    """

    @F.pandas_udf("array<double>")
    def carry(vec: pd.Series, mean: pd.Series, matrix: pd.Series) -> pd.Series:
        return pd.Series([(np.asarray(v) - m) @ np.asarray(x).reshape(len(m), -1) for v, m, x in zip(vec, mean, matrix)])

    named = maps.select(*keys, F.col("set").alias("__set"), "mean", "matrix")
    typed = rows.withColumn("__set", F.col(sets).cast("string"))
    joined = join_keys(typed, named, [*keys, "__set"])
    return joined.withColumn("vec", carry("vec", "mean", "matrix")).drop("mean", "matrix", "__set")


def aligned_trials(rows: DataFrame, seed: int = 42, sets: str = "subject", label: str = "label") -> DataFrame:
    """Trials with ``pick``, their rank within set and label in hash order, up to the least count that any set has.

    ``rows``: set, trial, label and more. Labels that a set lacks go.
    """
    text = st._seed_text(F.lit(str(seed)), sets, "trial")
    ranked = st.hashed_rank(rows.withColumnRenamed(label, "__label"), [sets, "__label"], text, ["trial"], "pick")
    counts = rows.groupBy(sets, F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    n_sets = rows.agg(F.countDistinct(sets).alias("__sets"))
    common = counts.groupBy("__label").agg(F.min("__n").alias("__n"), F.count(F.lit(1)).alias("__has"))
    common = join_keys(common, n_sets, []).filter(F.col("__has") == F.col("__sets")).select("__label", "__n")
    kept = ranked.join(F.broadcast(common), "__label").filter(F.col("pick") <= F.col("__n"))  # one row per label
    return kept.drop("__n").withColumnRenamed("__label", label)

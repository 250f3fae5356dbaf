"""Principal components of long vectors from additive sketches.

A Gram matrix of d x d is out of the question for trials of tens of thousands of values. ``basis`` finds an orthonormal
basis of the span of a key's vectors instead: tasks add up ``x (x' G)`` over their rows for a random d x r matrix G
that every task draws alike, so no row is shuffled, and what travels are d x r sums in strips of columns. Where a key has
at most ``rank`` rows its basis is exact; above, each of ``power`` further passes sharpens it (subspace iteration).
``compress`` writes every vector in the basis of its key: r numbers with the same means, distances and inner products.
All that follows (principal axes, folds as total minus fold, kernels) then works on short vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..plans import apply_model, cut_lineage, join_keys, join_measured, moments, run_blocks, split_blocks
from . import decoding as dc

STRIP = 16
#: Bytes of vectors in one block, and doubles of sums that a task holds.
BLOCK_BYTES, HELD_DOUBLES = 64 << 20, 16_000_000


def _strips(key: tuple, total: np.ndarray, sums: np.ndarray) -> Iterator[tuple]:
    """The columns of ``[total, sums]`` in strips."""
    whole = np.hstack([total[:, None], sums])
    for a in range(0, whole.shape[1], STRIP):
        yield (*key, a // STRIP, whole[:, a : a + STRIP].ravel())


def _fields(rows: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)


def _added(strips: DataFrame, keys: Sequence[str]) -> DataFrame:
    by = [*keys, "strip"]
    summed = strips.withColumn("__v", array_to_vector("acc")).groupBy(*by).agg(Summarizer.sum(F.col("__v")).alias("__v"))
    return summed.select(*by, vector_to_array("__v").alias("acc"))


def _orthonormal(strips: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, d, q (row-major d x r): an orthonormal basis of the summed columns; one key's d x r sums are one task's."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        d = int(frame["d"].iloc[0])
        y = np.hstack([np.asarray(a).reshape(d, -1) for _, a in sorted(zip(frame["strip"], frame["acc"]), key=lambda p: p[0])])
        norms = np.linalg.norm(y, axis=0)
        u, s, _ = np.linalg.svd(y / np.where(norms > 0, norms, 1), full_matrices=False)
        q = u[:, : max(1, int((s > s.max(initial=0.0) * 1e-12).sum()))]  # vectors of zeros still need an axis
        return pd.DataFrame([(*[frame[k].iloc[0] for k in keys], d, q.ravel())], columns=[*keys, "d", "q"])

    schema = ", ".join(x for x in (_fields(strips, keys), "d int, q array<double>") if x)
    return join_keys(strips, sizes.select(*keys, "d"), list(keys)).groupBy(*keys).applyInPandas(solve, schema)


def _rows_per_block(sizes: DataFrame) -> int:
    longest = sizes.agg(F.max("d")).first()[0] or 1
    return max(1, BLOCK_BYTES // (8 * longest))


def basis(
    rows: DataFrame, keys: Sequence[str], row_id: str, rank: int | None = 256, power: int = 3, vec: str = "vec", seed: int = 42
) -> DataFrame:
    """An orthonormal basis of each key's vectors (at least one key): keys, ``d``, ``q``, ``n``, ``squares``.

    Of up to ``rank`` directions (None: of all, the rows or the length of the vectors, whichever is less) and the mean. ``n`` counts the rows, ``squares`` is the sum of all squared values.
    Rows with a NULL vector are left out; a key's vectors have one length.
    """
    key_list = list(keys)
    valid = rows.filter(F.col(vec).isNotNull()).select(*key_list, row_id, F.col(vec).alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    sizes = cut_lineage(
        valid.groupBy(*key_list).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"), F.sum(square).alias("squares"))
    )
    every = F.least("n", "d").cast("int")
    sizes = sizes.withColumn("r", every if rank is None else F.least(every, F.lit(rank)))
    schema = f"{_fields(valid, key_list)}, strip int, acc array<double>"

    def draw(d: int, r: int) -> np.ndarray:
        return np.random.default_rng(seed).standard_normal((r, d)).T  # the first r columns, whatever r is

    def first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}
        doubles = 0

        def emit():
            for key, (total, sums) in held.items():
                for strip in _strips(key, total, sums):
                    yield pd.DataFrame([strip], columns=[*key_list, "strip", "acc"])

        for batch in batches:
            for key, part in batch.groupby(key_list, dropna=False, sort=False):
                x = np.array(part["vec"].tolist(), dtype=float)
                sums = x.T @ (x @ draw(x.shape[1], int(part["r"].iloc[0])))
                if key in held:
                    held[key][0] += x.sum(axis=0)
                    held[key][1] += sums
                else:
                    held[key] = [x.sum(axis=0), sums]
                    doubles += sums.size
                if doubles > HELD_DOUBLES:
                    yield from emit()
                    held.clear()
                    doubles = 0
        yield from emit()

    ranked = join_measured(valid.drop(row_id), sizes.select(*key_list, "r"), key_list)
    if rank is None:
        # a task's d x r sums are no larger than its r rows
        tasks = sizes.agg(F.max(F.ceil(F.col("n") / F.col("r")))).first()[0] or 1
        ranked = ranked.repartition(int(tasks), *key_list, F.pmod(F.xxhash64("vec"), F.lit(int(tasks))))
    found = _orthonormal(_added(ranked.mapInPandas(first_pass, schema), key_list), sizes, key_list)
    if power and not sizes.filter(F.col("r") < F.least("n", "d")).isEmpty():
        tagged = cut_lineage(split_blocks(valid, key_list, row_id, _rows_per_block(sizes)))

        def next_pass(block: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            x = np.array(block["vec"].tolist(), dtype=float)
            q = np.asarray(model["q"].iloc[0]).reshape(x.shape[1], -1)
            key = tuple(model[k].iloc[0] for k in key_list)
            return pd.DataFrame(list(_strips(key, x.sum(axis=0), x.T @ (x @ q))), columns=[*key_list, "strip", "acc"])

        for _ in range(power):
            strips = run_blocks(tagged, cut_lineage(found).select(*key_list, "q"), key_list, next_pass, schema)
            found = _orthonormal(_added(strips, key_list), sizes, key_list)
    return join_keys(cut_lineage(found), sizes.select(*key_list, "n", "squares"), key_list)


def compress(
    rows: DataFrame, bases: DataFrame, keys: Sequence[str], row_id: str, carry: Sequence[str] = (), vec: str = "vec"
) -> DataFrame:
    """Vectors in the basis of their key; the only shuffle of the long vectors."""
    columns = [*keys, row_id, *[c for c in carry if c not in (*keys, row_id)]]
    schema = f"{_fields(rows, columns)}, vec array<double>"

    def run(block: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        x = np.array(block[vec].tolist(), dtype=float)
        out = block[columns].copy()
        out["vec"] = list(x @ np.asarray(model["q"].iloc[0]).reshape(x.shape[1], -1))
        return out

    blocks = _rows_per_block(bases)
    valid = rows.filter(F.col(vec).isNotNull()).select(*columns, vec)
    return apply_model(valid, bases.select(*keys, "q"), keys, run, schema, row_id, blocks)


def fit_pca(
    rows: DataFrame, keys: Sequence[str], row_id: str, n_comp: float = 0.8, rank: int | None = 256, power: int = 3, vec: str = "vec", seed: int = 42
) -> DataFrame:
    """``decoding.fit_pca`` for long vectors: keys, ``n``, ``mean``, ``comps``, ``eigen``, ``ratio``.

    ``ratio`` is of the whole variance, also where the basis holds only a part of it; a share ``n_comp`` that the basis
    does not reach gives all its axes. ``rank`` None takes all directions: d x d numbers of a key at most.
    """
    key_list = list(keys)
    bases = basis(rows, key_list, row_id, rank, power, vec, seed)
    stats = moments(compress(rows, bases, key_list, row_id, vec=vec), key_list, "vec").drop("n")

    @F.pandas_udf(dc.PCA_SCHEMA)
    def fit(n: pd.Series, squares: pd.Series, total: pd.Series, gram: pd.Series, d: pd.Series, q: pd.Series) -> pd.DataFrame:
        out = []
        for count, square, t, g, size, basis_of in zip(n, squares, total, gram, d, q):
            t, axes_of = np.asarray(t), np.asarray(basis_of).reshape(int(size), -1)
            mean = t / count
            scatter = np.asarray(g).reshape(len(t), len(t)) - count * np.outer(mean, mean)
            values, vectors = np.linalg.eigh((scatter + scatter.T) / 2)
            values, vectors = np.clip(values[::-1], 0, None) / max(count - 1, 1), vectors[:, ::-1]
            whole = max((square - count * (mean @ mean)) / max(count - 1, 1), 0.0)
            ratio = values / whole if whole > 0 else np.full(len(values), 1.0 / len(values))
            k = int(np.searchsorted(np.cumsum(ratio), n_comp, side="right")) + 1 if n_comp < 1 else int(n_comp)
            k = max(1, min(k, len(values)))
            axes = (axes_of @ vectors[:, :k]).T
            lead = np.abs(axes).argmax(axis=1)
            axes = axes * np.sign(axes[np.arange(k), lead])[:, None]
            out.append((axes_of @ mean, axes.ravel(), values[:k], ratio[:k]))
        return pd.DataFrame(out, columns=["mean", "comps", "eigen", "ratio"])

    joined = join_keys(stats, bases, key_list)
    model = fit("n", "squares", "total", "gram", "d", "q")
    return joined.withColumn("__p", model).select(*key_list, "n", "__p.*")

"""Reducers and decoders that a caller supplies: partial, merge, solve.

An estimator never sees a whole training set. ``partial`` turns the training rows of one block into an array,
``merge`` puts two such arrays together, and ``solve`` makes the parameters of a model from what is left. The number of
rows of a subject therefore bounds no task; the length of the arrays is the estimator's own choice.

    partial(x, y, classes) -> array      rows (n x d), their labels, sorted labels of the training set
    merge(a, b) -> array                 None: addition; else associative and commutative
    solve(array, classes) -> parameters  a flat array
    apply(x, parameters) -> rows         of a reducer
    predict(x, parameters, classes) -> labels, of a decoder

Registered names can be used wherever an estimator is expected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..plans import cut_lineage

Array = np.ndarray
FAN_IN = 16  # partials that one task merges at a time


@dataclass(frozen=True)
class Reducer:
    partial: Callable[[Array, Array, Array], Array]
    solve: Callable[[Array, Array], Array]
    apply: Callable[[Array, Array], Array]
    merge: Callable[[Array, Array], Array] | None = None


@dataclass(frozen=True)
class Decoder:
    partial: Callable[[Array, Array, Array], Array]
    solve: Callable[[Array, Array], Array]
    predict: Callable[[Array, Array, Array], Array]
    merge: Callable[[Array, Array], Array] | None = None


REDUCERS: dict[str, Reducer] = {}
DECODERS: dict[str, Decoder] = {}


def register_reducer(name: str, reducer: Reducer) -> None:
    REDUCERS[name] = reducer


def register_decoder(name: str, decoder: Decoder) -> None:
    DECODERS[name] = decoder


def found(chosen, registry: dict, built_in: Sequence[str]):
    """The estimator behind a name, or itself; None for a built-in name."""
    if not isinstance(chosen, str):
        return chosen
    if chosen in registry:
        return registry[chosen]
    if chosen in built_in:
        return None
    raise ValueError(f"{chosen!r} is none of {sorted([*registry, *built_in])}")


def merged(partials: DataFrame, keys: Sequence[str], merge: Callable[[Array, Array], Array] | None) -> DataFrame:
    """One array per key from the partial arrays ``acc``.

    Sums are added with map-side combine. Another ``merge`` meets in rounds: ``FAN_IN`` partials of a key at a time, so
    no task holds all partials of a model.
    """
    keys = list(keys)
    if merge is None:
        summed = partials.withColumn("__v", array_to_vector("acc")).groupBy(*keys).agg(
            Summarizer.sum(F.col("__v")).alias("__v")
        )
        return summed.select(*keys, vector_to_array("__v").alias("acc"))
    schema = partials.select(*keys, "acc").schema

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        # in an order that does not depend on which task made which partial
        arrays = sorted((np.asarray(a, dtype=float) for a in frame["acc"]), key=lambda a: a.tobytes())
        whole = arrays[0]
        for other in arrays[1:]:
            whole = np.asarray(merge(whole, other), dtype=float)
        return pd.DataFrame([(*frame.iloc[0][keys], whole)], columns=[*keys, "acc"])

    left = cut_lineage(partials.select(*keys, "acc"))
    while True:
        most = left.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        buckets = -(-most // FAN_IN)
        bucket = F.pmod(F.xxhash64("acc"), F.lit(max(buckets, 1)))
        left = left.withColumn("__bucket", bucket).groupBy(*keys, "__bucket").applyInPandas(meet, schema)
        if buckets <= 1:
            return left
        left = cut_lineage(left)


def solved(sums: DataFrame, estimator: Reducer | Decoder, name: str) -> DataFrame:
    """Adds the parameters as ``name``; ``sums`` holds ``acc`` and ``classes``."""
    solve = estimator.solve

    @F.pandas_udf("array<double>")
    def run(acc: pd.Series, classes: pd.Series) -> pd.Series:
        return pd.Series([
            np.asarray(solve(np.asarray(a), np.asarray(c)), dtype=float).ravel() for a, c in zip(acc, classes)
        ])

    return sums.withColumn(name, run("acc", "classes")).drop("acc")


# --- estimators that come with the library -----------------------------------------


def _class_sums(x: Array, y: Array, classes: Array) -> Array:
    """Rows and sum of every class, one after another."""
    of = np.asarray(y)[:, None] == np.asarray(classes)[None]
    return np.concatenate([of.sum(axis=0), (of.T.astype(float) @ x).ravel()]).astype(float)


def _scatter_sums(x: Array, y: Array, classes: Array) -> Array:
    return np.concatenate([_class_sums(x, y, classes), (x.T @ x).ravel()])


def _scatters(acc: Array, classes: Array):
    """Rows and mean per class, scatter within classes."""
    k = len(classes)
    n = acc[:k]
    d = int(round((np.sqrt(k * k + 4 * (len(acc) - k)) - k) / 2))
    sums, gram = acc[k : k + k * d].reshape(k, d), acc[k + k * d :].reshape(d, d)
    mean = sums / np.maximum(n, 1.0)[:, None]
    within = gram - (mean * n[:, None]).T @ mean
    return n, mean, (within + within.T) / 2


def _ridged(within: Array, ridge: float) -> Array:
    """Scatter with ``ridge`` times its mean variance added to the diagonal."""
    d = len(within)
    scale = np.trace(within) / d
    return within + np.eye(d) * (ridge * scale if scale > 0 else 1.0)


def nearest_mean() -> Decoder:
    """The class whose mean is nearest; the lowest label of equal ones."""

    def solve(acc: Array, classes: Array) -> Array:
        k = len(classes)
        n = acc[:k]
        mean = acc[k:].reshape(k, -1) / np.maximum(n, 1.0)[:, None]
        return np.where(n[:, None] > 0, mean, np.inf)

    def predict(x: Array, parameters: Array, classes: Array) -> Array:
        mean = parameters.reshape(len(classes), -1)
        distance = np.array([((x - m) ** 2).sum(axis=1) for m in mean])
        return np.asarray(classes)[distance.argmin(axis=0)]

    return Decoder(_class_sums, solve, predict)


def discriminant_decoder(ridge: float = 1e-6) -> Decoder:
    """Linear discriminant analysis: one covariance for all classes, priors from the training set."""

    def solve(acc: Array, classes: Array) -> Array:
        n, mean, within = _scatters(acc, classes)
        cov = _ridged(within / max(n.sum() - (n > 0).sum(), 1.0), ridge)
        weight = np.linalg.solve(cov, mean.T).T
        with np.errstate(divide="ignore"):
            constant = np.log(n / n.sum()) - 0.5 * (weight * mean).sum(axis=1)
        return np.hstack([weight, constant[:, None]])

    def predict(x: Array, parameters: Array, classes: Array) -> Array:
        table = parameters.reshape(len(classes), -1)
        return np.asarray(classes)[(x @ table[:, :-1].T + table[:, -1]).argmax(axis=1)]

    return Decoder(_scatter_sums, solve, predict)


def discriminant_axes(n_axes: int, ridge: float = 1e-6) -> Reducer:
    """Axes that spread class means most against the scatter within classes; at most classes - 1."""

    def solve(acc: Array, classes: Array) -> Array:
        n, mean, within = _scatters(acc, classes)
        low = np.linalg.cholesky(_ridged(within / max(n.sum(), 1.0), ridge))
        centre = (mean * n[:, None]).sum(axis=0) / n.sum()
        spread = np.linalg.solve(low, ((mean - centre) * np.sqrt(n / n.sum())[:, None]).T)
        left, _, _ = np.linalg.svd(spread, full_matrices=False)
        k = max(1, min(n_axes, int((n > 0).sum()) - 1, left.shape[1]))
        axes = np.linalg.solve(low.T, left[:, :k])
        lead = np.abs(axes).argmax(axis=0)
        axes = axes * np.sign(axes[lead, np.arange(k)])
        return np.vstack([axes, centre @ axes])

    def apply(x: Array, parameters: Array) -> Array:
        table = parameters.reshape(x.shape[1] + 1, -1)
        return x @ table[:-1] - table[-1]

    return Reducer(_scatter_sums, solve, apply)


def unreduced() -> Reducer:
    """Rows as they are."""
    return Reducer(lambda x, y, classes: np.zeros(1), lambda acc, classes: acc, lambda x, parameters: x)


register_decoder("nearest_mean", nearest_mean())
register_decoder("discriminant", discriminant_decoder())
register_reducer("discriminant", discriminant_axes(32))
register_reducer("none", unreduced())

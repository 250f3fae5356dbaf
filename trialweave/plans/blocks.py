"""Additive statistics and model application over bounded blocks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from .ordering import join_keys
from .sizing import join_measured

_FLUSH_DOUBLES = 8_000_000  # partial sums held by one task before they are emitted


def moments(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Count, sum and Gram matrix of the row vectors in ``vec`` per key.

    Every task adds up the rows it already holds (no shuffle of rows) and emits one
    partial per key; the partials are then summed with map-side combine. The size of
    a partial depends on the vector length only. Result: keys, ``n``, ``total``
    (length d) and ``gram`` (length d*d, row-major). Rows with a NULL vector are left
    out.
    """
    key_list = list(keys)
    key_fields = [df.schema[k] for k in key_list]
    partial_schema = T.StructType(
        [*key_fields, T.StructField("__acc", T.ArrayType(T.DoubleType(), False))]
    )

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        doubles = 0

        def emit():
            rows = [(*key, acc) for key, acc in held.items()]
            return pd.DataFrame(rows, columns=[*key_list, "__acc"])

        for batch in batches:
            groups = batch.groupby(key_list, dropna=False, sort=False) if key_list else [((), batch)]
            for key, part in groups:
                key = tuple(key) if isinstance(key, (tuple, list)) else (key,)
                x = np.array(part[vec].tolist(), dtype=float)
                acc = np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
                if key in held:
                    held[key] += acc
                else:
                    held[key] = acc
                    doubles += acc.size
            if doubles > _FLUSH_DOUBLES:
                yield emit()
                held.clear()
                doubles = 0
        if held:
            yield emit()

    rows = df.select(*key_list, vec).filter(F.col(vec).isNotNull())
    acc = rows.mapInPandas(partials, partial_schema)
    acc = acc.withColumn("__vec", array_to_vector("__acc"))
    summed = acc.groupBy(*key_list).agg(vector_to_array(Summarizer.sum(F.col("__vec"))).alias("__acc"))
    # length is 1 + d + d*d
    d = ((F.sqrt(4 * F.size("__acc") - F.lit(3)) - 1) / 2).cast("int")
    return summed.select(
        *key_list,
        F.element_at("__acc", 1).cast("long").alias("n"),
        F.slice("__acc", F.lit(2), d).alias("total"),
        F.slice("__acc", d + 2, d * d).alias("gram"),
    )


def gram_tiles(df: DataFrame, keys: Sequence[str], vec: str, tile: int = 256) -> DataFrame:
    """Gram matrix of ``[1, vec]`` per key as tiles: keys, ``i``, ``j`` (``i <= j``), ``acc`` (row-major).

    Like ``moments``, for vectors whose whole Gram matrix would not fit one row: a shuffled row holds at most
    ``tile * tile`` doubles, and only the upper half is summed. ``whole_gram`` puts the tiles of one key together.
    """
    key_list = list(keys)
    partial_schema = T.StructType(
        [
            *[df.schema[k] for k in key_list], T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
            T.StructField("acc", T.ArrayType(T.DoubleType(), False)),
        ]
    )

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        doubles = 0

        def emit():
            for key, gram in held.items():
                steps = range(0, len(gram), tile)
                rows = [
                    (*key, a // tile, b // tile, gram[a : a + tile, b : b + tile].ravel()) for a in steps for b in steps if a <= b
                ]
                yield pd.DataFrame(rows, columns=[*key_list, "i", "j", "acc"])

        for batch in batches:
            for key, part in batch.groupby(key_list, dropna=False, sort=False):
                x = np.array(part[vec].tolist(), dtype=float)
                x = np.hstack([np.ones((len(x), 1)), x])
                gram = x.T @ x
                if key in held:
                    held[key] += gram
                else:
                    held[key] = gram
                    doubles += gram.size
                if doubles > _FLUSH_DOUBLES:
                    yield from emit()
                    held.clear()
                    doubles = 0
        yield from emit()

    parts = df.select(*key_list, vec).filter(F.col(vec).isNotNull()).mapInPandas(partials, partial_schema)
    summed = parts.withColumn("__v", array_to_vector("acc")).groupBy(*key_list, "i", "j").agg(Summarizer.sum(F.col("__v")).alias("__v"))
    return summed.select(*key_list, "i", "j", vector_to_array("__v").alias("acc"))


def whole_gram(tiles: pd.DataFrame, size: int, tile: int = 256) -> np.ndarray:
    """The Gram matrix of order ``size`` from the tiles of one key."""
    gram = np.zeros((size, size))
    for i, j, acc in zip(tiles["i"], tiles["j"], tiles["acc"]):
        height = min(tile, size - i * tile)
        block = np.asarray(acc).reshape(height, -1)
        gram[i * tile : i * tile + height, j * tile : j * tile + block.shape[1]] = block
        gram[j * tile : j * tile + block.shape[1], i * tile : i * tile + height] = block.T
    return gram


def split_blocks(
    rows: DataFrame, keys: Sequence[str], row_id: str, rows_per_block: int = 20_000
) -> DataFrame:
    """Add ``__block``: rows of a key spread by a hash of ``row_id`` over bounded blocks."""
    blocks = rows.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(rows_per_block)).cast("int").alias("__blocks")
    )
    return join_measured(rows, blocks, keys).withColumn(
        "__block", F.pmod(F.xxhash64(row_id), F.col("__blocks")).cast("int")
    )


def run_blocks(
    tagged: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Run ``fn(block_of_rows, models_of_the_key)`` on the output of ``split_blocks``.

    ``models`` holds one or a few rows per key; they are copied once per block rather than
    once per row. Keys without a model are dropped, like in an inner join.
    """
    sizes = tagged.select(*keys, "__blocks").distinct()
    copies = join_keys(models, sizes, keys)
    copies = copies.withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    ).drop("__blocks")
    # columns of their own, in case rows and models come from one table
    copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])
    names = [field.name for field in T.StructType.fromDDL(schema).fields]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({name: [] for name in names})
        return fn(left, right)

    by = [*keys, "__block"]
    return tagged.drop("__blocks").groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(run, schema)


def apply_model(
    rows: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    row_id: str,
    rows_per_block: int = 20_000,
) -> DataFrame:
    """``split_blocks`` and ``run_blocks`` in one step."""
    return run_blocks(split_blocks(rows, keys, row_id, rows_per_block), models, keys, fn, schema)

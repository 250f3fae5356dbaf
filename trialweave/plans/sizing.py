"""Broadcasts behind a size check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from .checkpoints import cut_lineage

BROADCAST_BYTES = 64 << 20


def _bytes(field: T.StructField):
    """Rough in-memory size of one value as a column expression."""
    if isinstance(field.dataType, T.ArrayType):
        per_item = 8 * len(field.dataType.elementType.fields) + 16 if isinstance(
            field.dataType.elementType, T.StructType
        ) else 16
        return F.coalesce(F.size(F.col(f"`{field.name}`")), F.lit(0)) * per_item + 32
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.length(F.col(f"`{field.name}`")), F.lit(0)) * 2 + 32
    return F.lit(16)


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table is small enough to broadcast."""
    row = F.lit(0)
    for field in table.schema.fields:
        row = row + _bytes(field)
    return (table.agg(F.sum(row).alias("size")).first().size or 0) <= limit


def measured(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise an aggregate and mark it for broadcast if it is small enough.

    The other side of a join with the result then stays where it is: no shuffle by a key
    that may hold a large share of its rows. Above the limit the table is returned without
    the mark and the join shuffles, with skewed keys split at run time.
    """
    table = cut_lineage(df)
    return F.broadcast(table) if fits_broadcast(table, limit) else table


def join_measured(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Equi-join with an aggregate whose size is checked first (see ``measured``)."""
    from .ordering import join_keys

    return join_keys(left, measured(right, limit), keys, how)

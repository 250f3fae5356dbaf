"""Joins of many rows with a table of unique keys, some of which a large share of the rows may name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.sizing import fits_broadcast

#: Rows naming a key from which it counts as hot.
HOT_ROWS = 1 << 16


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], uses: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of ``table``, whose keys are unique, not null and hold every key of ``rows``.

    Column ``uses`` of ``table`` is the number of rows that name a key, at least. Hot keys are at most
    ``rows / hot_rows``, so their part of the table is measured and, up to 64 MB, broadcast: their rows stay where they
    are. The other keys are joined by a shuffle in which none has more than ``hot_rows`` rows.
    """
    extra = [c for c in table.columns if c not in keys and c != uses]
    narrow = table.select(*keys, *extra, F.lit(True).alias("__found"))
    hot = narrow.filter(table[uses] > hot_rows)
    side = F.broadcast(hot) if fits_broadcast(hot) else hot
    first = rows.join(side, keys, "left")
    found = first.filter("__found").drop("__found")
    rest = first.filter("__found IS NULL").drop("__found", *extra)
    cold = narrow.filter(table[uses] <= hot_rows).drop("__found")
    return found.unionByName(rest.join(cold, keys))

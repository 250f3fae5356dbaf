"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has 64 bits: bit i tells whether the sum of the components i, i + 64, ... is positive. Codes are cut
into ``SEGMENTS`` segments, and a block of codes has a table per segment from segment value to codes. A search at
radius r probes all values within r flips of the query's segment, in each segment. By pigeonhole, all codes within
distance SEGMENTS * (r + 1) - 1 are then found, so the radius grows only until the k-th verified distance is
covered; ties at that distance are covered as well.

Equal codes are one entry, which carries its ``k + 1`` least ids; more of them cannot be among the results of any
query. Distinct codes are dealt to blocks of about ``block_codes``, queries (the stated query set) to blocks of
about ``query_codes``, also one entry per distinct code; each pair of blocks is searched exactly, in a task of bounded size,
and gives at most k + 1 codes per query, which are merged by distance and id.

A row is not its own neighbour. Results are ordered by (distance, id); fewer than k rows give fewer
neighbours. Null or empty vectors have no code: they are nobody's neighbour and have no neighbours. Null
components and NaN count as 0. Rows without id are ignored; ids that repeat with equal vectors count once. Other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import stored

BITS = 64
SEGMENTS = 4
_WIDTH = BITS // SEGMENTS


def codes(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id long, code long), without rows that have no code."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            lengths = np.array([len(v) if v.is_valid else 0 for v in column], np.int64)
            flat = np.nan_to_num(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64))
            row = np.repeat(np.arange(len(lengths)), lengths)
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            sums = np.zeros((len(lengths), BITS))
            np.add.at(sums, (row, inside % BITS), flat)
            packed = np.packbits(sums > 0, axis=1, bitorder="little").view(np.int64)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed)], names=["id", "code"])

    rows = vectors.filter(F.col(id_column).isNotNull() & (F.size(vector) > 0))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, code long")


class Tables:
    """Segment tables of a block of codes (distinct, with the least id of each)."""

    def __init__(self, code: np.ndarray, low_id: np.ndarray):
        self.code, self.low_id = code.view(np.uint64), low_id
        self.order, self.begin = [], []
        for s in range(SEGMENTS):
            value = self._segment(self.code, s)
            self.order.append(np.argsort(value, kind="stable"))
            self.begin.append(np.searchsorted(value[self.order[-1]], np.arange((1 << _WIDTH) + 1)))

    @staticmethod
    def _segment(code: np.ndarray, s: int) -> np.ndarray:
        return ((code >> np.uint64(s * _WIDTH)) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray, k: int, together: int = 64):
        """(query index, code index, distance) of the k nearest codes by (distance, least id)."""
        out = []
        for a in range(0, len(queries), together):
            out.append(self._search(queries[a : a + together].view(np.uint64), a, k))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def _search(self, queries: np.ndarray, offset: int, k: int):
        k = min(k, len(self.code))
        best = (np.zeros(0, np.int64),) * 3
        active = np.arange(len(queries))
        bound = np.full(len(queries), BITS + 1)
        for radius in range(_WIDTH + 1):
            flips = flip_masks(radius)
            found_q, found_c = [best[0]], [best[1]]
            for s in range(SEGMENTS):
                value = self._segment(queries[active], s)[:, None] ^ flips
                low, high = self.begin[s][value], self.begin[s][value + 1]
                many = (high - low).ravel()
                at = np.repeat(low.ravel() - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                code = self.order[s][at]
                query = np.repeat(np.repeat(active, len(flips)), many)
                near = np.bitwise_count(self.code[code] ^ queries[query]) <= bound[query]
                found_q.append(query[near])
                found_c.append(code[near])
            pair = np.unique(np.concatenate(found_q) * len(self.code) + np.concatenate(found_c))
            query, code = pair // len(self.code), pair % len(self.code)
            distance = np.bitwise_count(self.code[code] ^ queries[query]).astype(np.int64)
            order = np.lexsort((self.low_id[code], distance, query))
            query, code, distance = query[order], code[order], distance[order]
            first = np.searchsorted(query, np.arange(len(queries)))
            rank = np.arange(len(query)) - first[query]
            top = rank < k
            best = (query[top], code[top], distance[top])
            last = rank == k - 1
            bound[query[last]] = distance[last]
            # all codes within SEGMENTS * (radius + 1) - 1 have been seen
            active = active[bound[active] >= SEGMENTS * (radius + 1)]
            if not len(active):
                break
        return best[0] + offset, best[1], best[2]


_FLIPS: dict[int, np.ndarray] = {}


def flip_masks(radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits set."""
    if radius not in _FLIPS:
        _FLIPS[radius] = np.array([sum(1 << b for b in c) for c in combinations(range(_WIDTH), radius)], np.int64)
    return _FLIPS[radius]


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding",
    block_codes: int = 1 << 14, query_codes: int = 1 << 11,
) -> DataFrame:
    """(query_id, rank 1.., neighbour_id, distance) for the rows where ``is_query`` holds (on ``id_column``)."""
    coded = stored(codes(vectors, id_column, vector).distinct(), "codes")
    some_ids = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
    # two steps, so that a code with very many rows is never gathered in one place
    part = coded.groupBy("code", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"), F.floor(F.col("id") / F.lit(1 << 12)).alias("run"))
    part = part.agg(some_ids.alias("ids")).groupBy("code", "part").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    index = part.groupBy("code").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    index = stored(index.withColumn("low_id", F.element_at("ids", 1)), "code-index")
    asked = stored(coded.withColumnRenamed("id", id_column).filter(is_query).withColumnRenamed(id_column, "query_id"), "queries")
    query_list = asked.select("code").distinct()
    n_blocks = max(1, -(-index.count() // block_codes))
    n_queries = max(1, -(-query_list.count() // query_codes))
    block = F.pmod(F.xxhash64("code"), F.lit(n_blocks)).alias("block")
    query_block = F.pmod(F.xxhash64("code", F.lit(3)), F.lit(n_queries)).alias("query_block")
    left = index.select(block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))).alias("query_block"), "code", "low_id")
    right = query_list.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), query_block, "code")

    def run(_, codes_pdf, queries_pdf):
        import pandas as pd

        asked_codes = queries_pdf["code"].to_numpy(np.int64)
        if not len(codes_pdf) or not len(asked_codes):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "code": pd.Series(dtype="int64"), "distance": pd.Series(dtype="int32")})
        code = codes_pdf["code"].to_numpy(np.int64)
        q, c, d = Tables(code, codes_pdf["low_id"].to_numpy(np.int64)).search(asked_codes, k + 1)
        return pd.DataFrame({"query": asked_codes[q], "code": code[c], "distance": d.astype(np.int32)})

    near = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInPandas(
        run, "query long, code long, distance int"
    )
    # k + 1 codes per query and block: merged, then expanded to ids
    first = Window.partitionBy("query").orderBy("distance", "low_id")
    near = near.join(index, "code").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    ids = near.select("query", "distance", F.explode("ids").alias("neighbour_id"))
    closest = Window.partitionBy("query").orderBy("distance", "neighbour_id")
    ids = ids.withColumn("place", F.row_number().over(closest)).filter(F.col("place") <= k + 1)
    lists = ids.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "neighbour_id", "distance"))).alias("near"))
    rows = asked.join(lists, asked["code"] == lists["query"]).select("query_id", F.explode("near").alias("n"))
    rows = rows.filter(F.col("n.neighbour_id") != F.col("query_id"))
    own = Window.partitionBy("query_id").orderBy("n.place")
    return rows.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("n.neighbour_id").alias("neighbour_id"), F.col("n.distance").alias("distance")
    )

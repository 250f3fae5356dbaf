"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in hash order, are cut into blocks of about ``block_chars`` characters. Each block is a
task of its source: block j of a source with weight w is released at slot floor(j / w) and due at ceil((j + 1) / w).
Earliest deadline first over the released blocks gives every slot one block, and every source has at any
slot less than one block more or less than its weight asks for.

Weights are rounded to multiples of 1/``slots``; the schedule then repeats after ``slots`` slots, so one period is
computed on the driver (``slots`` entries, whatever the data) and block numbers are looked up in it. When the blocks of a
source run out, the others go on with their weights scaled up: a new phase with a schedule of its own. So
nothing is dropped, and the order meets the target weights for as long as the sources allow. Sources are a list that
fits the driver, as target weights are.

Null source is a source of its own. Sources without a target weight follow behind the weighted ones in proportion
to their size; weights must be positive. Null and empty texts count one character. Rows that tie (equal doc_id and
text) stand next to each other. An empty table gives none. Columns of the input stay; ``mix_slot``,
``mix_block`` and ``mix_place`` are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, functions as F

from ..plans.ordering import number_rows, running_sum
from .jaccard import small_side
from .store import stored

SLOTS = 4096
NO_SOURCE = "\0none"


def rounded(weights: Mapping[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Weights as whole slots of a period, at least one each, by largest remainder."""
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) * slots / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (-(exact[s] - int(exact[s])), s))
    spare = slots - sum(out.values())
    i = 0
    while spare > 0:
        out[by_rest[i % len(by_rest)]] += 1
        spare, i = spare - 1, i + 1
    while spare < 0:
        largest = max(out, key=lambda s: (out[s], s))
        out[largest] -= 1
        spare += 1
    return out


def period(shares: Mapping[str, int]) -> list[str]:
    """The source of each slot of one period: earliest deadline first over released blocks."""
    slots = sum(shares.values())
    # (release, deadline, source, block); a block enters the second heap when it is released
    waiting = [(0, -(-slots // c), s, 0) for s, c in sorted(shares.items())]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    order = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        if due <= t:
            raise RuntimeError("a block missed its deadline")
        order.append(s)
        c = shares[s]
        if j + 1 < c:
            heapq.heappush(waiting, ((j + 1) * slots // c, -(-(j + 2) * slots // c), s, j + 1))
    return order


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], slots: int = SLOTS) -> list[tuple]:
    """Phases of the whole schedule: (first slot, slots, period, {source: blocks before the phase})."""
    left, done, out, at = dict(blocks), {s: 0 for s in blocks}, [], 0
    left = {s: n for s, n in left.items() if n}
    while left:
        # a period needs a slot for every source
        order = period(rounded({s: weights[s] for s in left}, max(slots, 2 * len(left))))
        count = {s: 0 for s in left}
        for s in order:
            count[s] += 1
        whole = min(n // count[s] for s, n in left.items())
        taken = {s: whole * count[s] for s in left}
        length = whole * len(order)
        if all(taken[s] < n for s, n in left.items()):  # the first source to run out does so within a period
            for s in order:
                length += 1
                taken[s] += 1
                if taken[s] == left[s]:
                    break
        out.append((at, length, order, {s: done[s] for s in left}))
        at += length
        for s in taken:
            done[s] += taken[s]
            left[s] -= taken[s]
        left = {s: n for s, n in left.items() if n}
    return out


def mix(documents: DataFrame, weights: Mapping[str, float], block_chars: int = 1 << 16, slots: int = SLOTS) -> DataFrame:
    """Add mix_slot (of the block), mix_block (within its source) and mix_place (1.. within its block)."""
    spark = documents.sparkSession
    kept = [c for c in documents.columns if c not in ("mix_slot", "mix_block", "mix_place")]
    rows = documents.select(*[F.col(f"`{c}`") for c in kept])
    key = F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))
    hashed = F.xxhash64("doc_id", "text")
    size = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")
    # places are found from narrow columns; two documents of one hash share a place
    narrow = rows.select(key.alias("source"), hashed.alias("place"), size.alias("size"))
    distinct = narrow.groupBy("source", "place").agg(F.sum("size").alias("size"))
    ran = running_sum(distinct, ["source"], ["place"], "size", "upto")
    number = F.floor((F.col("upto") - F.col("size")) / F.lit(block_chars)).cast("long")
    placed = stored(ran.select("source", "place", number.alias("wide")), "mix-places")
    # long documents skip numbers; blocks are numbered densely
    dense = placed.groupBy("source", "wide").agg(F.count(F.lit(1)).alias("n"))
    dense = stored(number_rows(dense, ["source"], ["wide"], "block").withColumn("block", F.col("block") - 1).drop("n"), "mix-blocks")
    counts = {r["source"]: r["n"] for r in dense.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = []
    given = {s: float(w) for s, w in weights.items() if s in counts}
    for part in (given, {s: float(n) for s, n in counts.items() if s not in given}):
        base = table[-1][0] + table[-1][1] if table else 0
        for first, length, order, before in phases({s: counts[s] for s in part}, part, slots):
            table.append((base + first, length, order, before))
    numbered = dense.join(small_side(_starts(spark, table)), "source")  # a row per source and phase
    numbered = numbered.filter((F.col("block") >= F.col("before")) & (F.col("block") < F.col("before") + F.col("taken")))
    inside = F.col("block") - F.col("before")
    numbered = numbered.withColumn("turn", F.floor(inside / F.col("share")).cast("long")).withColumn("nth", (inside % F.col("share")).cast("int"))
    slot = F.col("first") + F.col("turn") * F.col("period") + F.element_at("places", F.col("nth") + 1)
    numbered = numbered.select("source", "wide", "block", slot.alias("mix_slot"))
    found = placed.join(numbered, ["source", "wide"]).select(
        F.col("source").alias("__s"), F.col("place").alias("__p"), "mix_slot", F.col("block").alias("mix_block")
    )
    tagged = rows.withColumns({"__s": key, "__p": hashed})
    return tagged.join(small_side(stored(found, "mix-slots")), ["__s", "__p"]).withColumn("mix_place", F.col("__p")).drop("__s", "__p")


def _starts(spark, table):
    """One row per phase and source: its slots in a period, as an array."""
    out = []
    for first, length, order, before in table:
        places: dict[str, list[int]] = {s: [] for s in before}
        for i, s in enumerate(order):
            places[s].append(i)
        whole, rest = divmod(length, len(order))
        for s, begun in before.items():
            taken = whole * len(places[s]) + sum(p < rest for p in places[s])
            out.append((s, first, len(order), begun, taken, len(places[s]), places[s]))
    schema = "source string, first long, period long, before long, taken long, share int, places array<int>"
    return spark.createDataFrame(out, schema)


def tempered_weights(documents: DataFrame, power: float = 0.5) -> dict[str, float]:
    """Target weights: characters of a source to a power below one."""
    key = F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))
    sizes = documents.groupBy(key.alias("s")).agg(F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1))).alias("n"))
    return {r["s"]: float(r["n"]) ** power for r in sizes.collect()}

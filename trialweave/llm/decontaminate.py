"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A *window* is
``WINDOW`` consecutive words of an item; an item of fewer, but not none, is one window. Both sides are
fingerprinted alike: of the hashes of the ``GRAM``-word grams inside a window the least is kept, so a window that
stands in a document leaves the same fingerprint there as in its item. Document fingerprints that are among
the item fingerprints are extended to the whole window, which is then compared; overlapping hits join to spans.
For items shorter than a window the gram is the whole item (a sliding window of one gram). No shared span of
``WINDOW`` words can be missed, and windows are compared by 64-bit hashes of all their words.

The benchmark is a query set: it is indexed in blocks of about ``block_bytes`` of text, each small enough to
be sent to every task, and documents pass by each block in turn (by one for benchmarks below that size).
Documents are never shuffled.

Null or wordless texts have no words, no hits, and are not contaminated. Items without id or words are
ignored; items that repeat an id count once. Repeated documents are judged each. Columns of the input that bear
the name of a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.checkpoints import cut_lineage
from .kernels import ALNUM, FOLDED_VALUES, gram_hashes, span_hashes, text_slices, words

WINDOW = 13
GRAM = 5
RESULTS = ("n_words", "hit_spans", "items")


def winnow(grams: np.ndarray, size: int) -> np.ndarray:
    """The least of ``size`` neighbouring values from each position on."""
    out, reach = grams, 1
    while reach < size:
        step = min(reach, size - reach)
        out = np.minimum(out[: len(out) - step], out[step:])
        reach += step
    return out


class Index:
    """Windows of a block of items, by length."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = sorted({name for name, _ in items})
        rank = {name: i for i, name in enumerate(self.names)}
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i, j, data, offsets in text_slices(pa.array([t for _, t in items], pa.large_string())):
            starts, ends, at = words(data, offsets, ALNUM)
            hashes = span_hashes(data, starts, ends, FOLDED_VALUES)
            for k in range(j - i):
                own = hashes[at[k] : at[k + 1]]
                if not len(own):
                    continue
                size = min(WINDOW, len(own))
                gram = min(GRAM, size) if size == WINDOW else size
                windows = gram_hashes(own, size)
                least = winnow(gram_hashes(own, gram), size - gram + 1)
                item = np.full(len(windows), rank[items[i + k][0]], np.int64)
                found.setdefault(size, []).append((windows, least, item))
        self.by_size = {}
        for size, parts in sorted(found.items()):
            windows, least, item = (np.concatenate(x) for x in zip(*parts))
            pairs = np.unique(np.stack([windows, item.astype(np.uint64)], 1), axis=0)
            distinct, first = np.unique(pairs[:, 0], return_index=True)
            self.by_size[size] = (
                np.unique(least), distinct, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)
            )

    def hits(self, hashes: np.ndarray, at: np.ndarray):
        """(first word, size, item) of every window that stands in the texts; one row per window and item."""
        firsts, sizes, items = [], [], []
        text_end = np.repeat(at[1:], np.diff(at))
        for size, (prints, windows, begin, item) in self.by_size.items():
            gram = GRAM if size == WINDOW else size
            n = len(hashes) - size + 1
            if n <= 0:
                continue
            least = winnow(gram_hashes(hashes, gram), size - gram + 1)
            kept = np.ones(n, bool)  # a fingerprint that neighbouring windows share is looked up once
            kept[1:] = least[1:] != least[:-1]
            looked = np.flatnonzero(kept)
            place = np.minimum(np.searchsorted(prints, least[looked]), len(prints) - 1)
            shared = prints[place] == least[looked]
            if not shared.any():
                continue
            near = np.repeat(shared, np.diff(np.append(looked, n)))
            near &= np.arange(n) + size <= text_end[:n]
            first = np.flatnonzero(near)
            whole = gram_hashes(hashes, size)[first]
            place = np.minimum(np.searchsorted(windows, whole), len(windows) - 1)
            same = windows[place] == whole
            first, place = first[same], place[same]
            many = begin[place + 1] - begin[place]
            firsts.append(np.repeat(first, many))
            sizes.append(np.full(int(many.sum()), size))
            run = np.cumsum(many) - many
            items.append(item[np.repeat(begin[place] - run, many) + np.arange(int(many.sum()))])
        if not firsts:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        return np.concatenate(firsts), np.concatenate(sizes), np.concatenate(items)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _judge(column: pa.Array, index: Index):
    """Per text: number of words, hit spans (word positions, end exclusive), item names in order."""
    for i, j, data, offsets in text_slices(column):
        starts, ends, at = words(data, offsets, ALNUM)
        hashes = span_hashes(data, starts, ends, FOLDED_VALUES)
        first, size, item = index.hits(hashes, at)
        spans: dict[int, list] = {}
        names: dict[int, list] = {}
        if len(first):
            cover = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + size, -1)
            hit = np.cumsum(cover)[:-1] > 0
            edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
            border = np.flatnonzero(np.isin(np.arange(len(hit) + 1), at))  # spans end with their text
            opens = np.union1d(np.flatnonzero(edge == 1), border[:-1][hit[np.minimum(border[:-1], len(hit) - 1)] & (border[:-1] < len(hit))])
            for a in opens.tolist():
                text = int(np.searchsorted(at, a, "right")) - 1
                stop = int(at[text + 1])
                run = hit[a:stop]
                b = a + (len(run) if run.all() else int(run.argmin()))
                spans.setdefault(text, []).append((a - int(at[text]), b - int(at[text])))
            text = np.searchsorted(at, first, "right") - 1
            for t, k in np.unique(np.stack([text, item], 1), axis=0).tolist():
                names.setdefault(t, []).append(index.names[k])
        for k in range(j - i):
            yield int(at[k + 1] - at[k]), spans.get(k, []), names.get(k, [])


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Indexes of the items, one block at a time."""
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), "text"
    )
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-size // block_bytes) or 1
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield b == blocks - 1, Index([tuple(r) for r in part.collect()])


def score(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """``keep`` columns (default all) plus n_words long, hit_spans array<struct<start,end>> and items array<string>."""
    spark = documents.sparkSession
    kept = [c for c in (keep or documents.columns) if c not in RESULTS]
    carried = [c for c in dict.fromkeys([*kept, "text"])]
    frame = documents.select(*[F.col(f"`{c}`") for c in carried])
    frame = frame.withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "hit_spans": F.lit(None).cast("array<struct<start:long,end:long>>"),
            "items": F.lit(None).cast("array<string>"),
        }
    )
    names, where = frame.columns, carried.index("text")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def passing(shared, last):
        drop_text = last and "text" not in kept

        def run(batches):
            for batch in batches:
                n, spans, items = [], batch.column("hit_spans").to_pylist(), batch.column("items").to_pylist()
                for k, (count, more, found) in enumerate(_judge(batch.column(where), shared.value)):
                    n.append(count)
                    spans[k] = [(s["start"], s["end"]) for s in spans[k] or []]
                    if more:
                        spans[k] = _merged(spans[k] + more)
                        items[k] = sorted({*(items[k] or []), *found})
                columns = [batch.column(c) for c in carried if not (drop_text and c == "text")]
                spans = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], spans_type)
                items = pa.array([x or [] for x in items], pa.list_(pa.string()))
                out = [c for c in names if not (drop_text and c == "text")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), spans, items], names=out)

        return run

    for last, index in _blocks(benchmark, block_bytes):
        run = passing(spark.sparkContext.broadcast(index), last)
        frame = frame.mapInArrow(run, frame.drop("text").schema if last and "text" not in kept else frame.schema)
        if not last:
            frame = cut_lineage(frame)
    return frame


def n_hit():
    return F.coalesce(F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0))


def contaminated():
    """The rule: some word is hit, and at least one word in twenty."""
    return (n_hit() > 0) & (n_hit() * 20 >= F.col("n_words"))

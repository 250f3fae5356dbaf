"""Near-duplicate passages (substring deduplication) by compact windows.

Texts are sequences of ``SHINGLE``-word shingles. For each of ``HASHES`` hash functions a Cartesian tree over the
shingle hashes is built from the root down, as long as a subtree spans ``SPAN`` shingles (``WORDS`` words): such a
subtree is a *compact window* (l, c, r), and all passages that start in l..c and end in c..r share the least hash,
that of shingle c. A text has about 2 / SPAN of them per shingle and function, whatever its passages.

* A key is a pair of least hashes under two functions that one passage of ``WORDS`` words has (``occurrences``), so all
  texts that can hold a candidate together meet in a bucket. Keys of one text only are dropped.
* First round: in every bucket each text is paired with the least and the greatest text, so pairs grow with the rows,
  not with their square. For a pair the compact windows with equal hash are joined as intervals: passages of ``WORDS``
  words on nearly the same diagonal that share at least ``ENOUGH`` functions are candidates.
* Candidates are verified: the Jaccard similarity of the shingles of both passages, matched on the diagonal with up
  to ``SLACK`` words of drift, must be 0.8 or more. Overlapping verified passages join to maximal spans.
* Second round: in buckets of four texts or more, what is still outside the verified spans is compared with the whole
  bucket, block by block inside tasks, so the choice of partners loses nothing. K texts that share two least hashes in
  a passage without repeating it cost K^2 comparisons there; they give no rows.

Texts with equal words are one text; its copies repeat each other in full length. Result: a row per document and
span, in words (split at white space, A-Z lower-cased), with a document that holds the other passage. Documents
without such a passage, texts below ``WORDS`` words, null and empty texts give no row; repeats within one text alone
do not count; rows without doc_id are ignored; rows that repeat a doc_id with equal text count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .jaccard import BLOCK, _runs, key_rows, shared_keys, small_side
from .kernels import FOLDED_VALUES, NONSPACE, gram_hashes, mix, span_hashes, text_slices, words
from .store import Scratch, stored

SHINGLE = 5
WORDS = 50
SPAN = WORDS - SHINGLE + 1
HASHES = 4
ENOUGH = 2
SLACK = 2
#: Matching shingles of a passage at similarity 0.8: m / (2 * SPAN - m) >= 0.8.
MATCHING = -(-8 * 2 * SPAN // 18)
_U = np.uint64
_SALTS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407))


def shingle_rows(column: pa.Array):
    """(number of words, id, shingle hashes in order) of every text."""
    for i, j, data, offsets in text_slices(column):
        starts, ends, at = words(data, offsets, NONSPACE)
        hashes = span_hashes(data, starts, ends, FOLDED_VALUES)
        grams = gram_hashes(hashes, SHINGLE)
        for k in range(j - i):
            a, b = int(at[k]), int(at[k + 1])
            if b == a:
                yield 0, None, np.zeros(0, np.uint64)
                continue
            whole = int(mix(gram_hashes(hashes[a:b], b - a)).view(np.int64)[0])
            yield b - a, whole, grams[a : max(a, b - SHINGLE + 1)]


def _least_places(values: np.ndarray, borders: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least value of some ``width`` values in a row of one sequence, equal ones included."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def slid(x, fn):
        """``fn`` over each ``width`` values in a row, from runs twice as long in every step."""
        k = 1
        while 2 * k <= width:
            x, k = fn(x[:-k], x[k:]), 2 * k
        return fn(x[: len(x) - width + k], x[width - k :]) if k < width else x

    # 0 where the values cross a border, so that no place holds it
    padded = np.zeros(n + 2 * (width - 1), values.dtype)
    inner = padded[width - 1 : width - 1 + n]
    inner[:] = slid(values, np.minimum)
    crossing = borders[1:-1, None] - np.arange(1, width)
    inner[crossing[(crossing >= 0) & (crossing < n)]] = 0
    return np.flatnonzero(values == slid(padded, np.maximum))


def compact_windows(values: np.ndarray, borders: np.ndarray | None = None, least: int = SPAN) -> np.ndarray:
    """Rows (l, c, r) of the Cartesian tree nodes that span ``least`` values or more; of equal values the middle one is above.

    ``borders`` cuts the values into sequences with a tree each. All trees grow together, a level at a time: one minimum
    per open stretch. An open stretch is as long as ``least``, so its minimum is one of ``_least_places``, and only
    those are read.
    """
    borders = np.array([0, len(values)]) if borders is None else borders
    low, stop = borders[:-1].astype(np.int64), borders[1:].astype(np.int64)
    places = _least_places(values, borders.astype(np.int64), least)
    values = values[places]
    levels = []
    while True:
        wide = stop - low >= least
        low, stop = low[wide], stop[wide]
        if not len(low):
            break
        first = np.searchsorted(places, low)
        size = np.searchsorted(places, stop) - first
        begin = np.cumsum(size) - size
        place = np.repeat(first - begin, size) + np.arange(int(size.sum()))
        part = values[place]
        hit = np.flatnonzero(part == np.repeat(np.minimum.reduceat(part, begin), size))
        c = places[place[hit]]
        if len(c) > len(low):
            owner = np.searchsorted(begin, hit, "right") - 1
            away = np.abs(c - low[owner] - (stop - low)[owner] // 2)
            order = np.lexsort((c, away, owner))
            c = c[order[np.append(True, np.diff(owner[order]) > 0)]]
        levels.append(np.stack([low, c, stop - 1], axis=1))
        low, stop = np.stack([low, c + 1], axis=1).ravel(), np.stack([c, stop], axis=1).ravel()
    return np.concatenate(levels) if levels else np.zeros((0, 3), np.int64)


def _all_windows(tokens: np.ndarray, borders: np.ndarray | None = None):
    """(hash of the least shingle with the function in bits 2 and 3, l, c, r) over all functions, as arrays."""
    # all functions in one go: their values stand one after the other
    n = len(tokens)
    values = np.concatenate([mix(tokens ^ salt) for salt in _SALTS])
    ends = np.array([n]) if borders is None else borders[1:].astype(np.int64)
    found = compact_windows(values, np.append(0, (ends + n * np.arange(HASHES)[:, None]).ravel()))
    function = found[:, 1] // max(n, 1)
    keys = (values[found[:, 1]] & ~_U(15)) | (function.astype(np.uint64) << _U(2))
    return keys, found - n * function[:, None]


#: What a pair needs of a window: a short hash, the place of the least shingle, and the passages of WORDS words that
#: have it, from ``first`` to ``last``.
_WINDOW = np.dtype([("value", "<u4"), ("c", "<i4"), ("first", "<i4"), ("last", "<i4")])


def _windows(tokens: np.ndarray, borders: np.ndarray | None = None) -> np.ndarray:
    keys, places = _all_windows(tokens, borders)
    out = np.zeros(len(keys), _WINDOW)
    low, c, high = places.T
    out["value"] = ((keys >> _U(32)) & ~_U(3)) | ((keys >> _U(2)) & _U(3))
    out["c"], out["first"], out["last"] = c, np.maximum(low, c - SPAN + 1), np.minimum(c, high - SPAN + 1)
    return out


def window_table(tokens: np.ndarray) -> np.ndarray:
    out = _windows(tokens)
    return out[np.argsort(out["value"], kind="stable")]


def window_tables(tokens: np.ndarray, borders: np.ndarray) -> list[np.ndarray]:
    """``window_table`` of every sequence between the borders."""
    out = _windows(tokens, borders)
    text = np.searchsorted(borders, out["c"], "right") - 1
    for name in ("c", "first", "last"):
        out[name] -= borders[text].astype(np.int32)
    order = np.lexsort((out["value"], text))
    at = np.searchsorted(text[order], np.arange(len(borders)))
    out = out[order]
    return [out[i:j] for i, j in zip(at[:-1], at[1:])]


_F, _G = (np.array(x) for x in zip(*((f, g) for f in range(HASHES) for g in range(f + 1, HASHES))))


def occurrences(windows: np.ndarray, borders: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last, c): runs of passages of ``WORDS`` words, by first word, whose least shingles under two functions
    are the same; c is the place of that of the first function. The two low bits of a key are 0.

    ``windows`` are those of one text, or of all sequences between ``borders`` with places over all of them.
    """
    if not len(windows):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    # every passage lies in one window per function
    function = windows["value"] & 3
    edges = np.unique(windows["first"])
    value, at = np.empty((HASHES, len(edges)), np.uint64), np.empty((HASHES, len(edges)), np.int64)
    for f in range(HASHES):
        own = windows[function == f]
        own = own[np.argsort(own["first"])]
        place = np.searchsorted(own["first"], edges, "right") - 1
        value[f], at[f] = own["value"][place], own["c"][place]
    fresh = np.ones((len(_F), len(edges)), bool)
    fresh[:, 1:] = (at[_F, 1:] != at[_F, :-1]) | (at[_G, 1:] != at[_G, :-1])
    pair, edge = np.nonzero(fresh)
    key = mix((value[_F[pair], edge] << _U(32)) | value[_G[pair], edge]) & ~_U(3)
    first = edges[edge].astype(np.int64)
    last = np.append(first[1:], 0) - 1
    last[np.append(pair[1:] != pair[:-1], True)] = windows["last"].max()
    if borders is not None:
        text = np.searchsorted(borders, first, "right") - 1
        ends = borders[text + 1] - SPAN  # the last passage of a text
        last = np.minimum(last, ends)
    return key, first, last, at[_F[pair], edge]


def shingled(column: pa.Array):
    """(rows, ids, shingle hashes of the texts that hold a passage, borders) of a slice of texts."""
    for i, _, data, offsets in text_slices(column):
        starts, ends, at = words(data, offsets, NONSPACE)
        hashes = span_hashes(data, starts, ends, FOLDED_VALUES)
        grams = gram_hashes(hashes, SHINGLE)
        long = np.flatnonzero(np.diff(at) >= WORDS)
        if not len(long):
            continue
        count = at[long + 1] - at[long] - SHINGLE + 1
        borders = np.append(0, np.cumsum(count))
        own = [int(mix(gram_hashes(hashes[at[k] : at[k + 1]], int(at[k + 1] - at[k]))).view(np.int64)[0]) for k in long]
        yield i + long, own, grams[np.repeat(at[long] - borders[:-1], count) + np.arange(borders[-1])], borders


def keyed_texts(column: pa.Array):
    for _, ids, tokens, borders in shingled(column):
        key, first, _, _ = occurrences(_windows(tokens, borders), borders)
        text = np.searchsorted(borders, first, "right") - 1
        order = np.lexsort((key, text))
        key, text = key[order], text[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))
        key, text = key[fresh], text[fresh]
        at = np.searchsorted(text, np.arange(len(ids) + 1))
        for k, own in enumerate(ids):
            yield own, lambda part=key[at[k] : at[k + 1]]: part


#: Compact windows of pairs, and first words of passages, that a task compares at once.
WINDOWS, PLACES = 1 << 14, 1 << 16


def _matches(a: np.ndarray, b: np.ndarray, diagonal: int) -> np.ndarray:
    """Per shingle of ``a``: whether ``b`` has it at the diagonal, give or take ``SLACK``."""
    start = diagonal - SLACK
    if start >= 0 and start + len(a) + 2 * SLACK <= len(b):  # all drifts in one go
        size = b.itemsize
        return (np.ndarray((2 * SLACK + 1, len(a)), b.dtype, b, start * size, (size, size)) == a).any(axis=0)
    out = np.zeros(len(a), bool)
    for drift in range(-SLACK, SLACK + 1):
        d = diagonal + drift
        low, high = max(0, -d), min(len(a), len(b) - d)
        if low < high:
            out[low:high] |= a[low:high] == b[low + d : high + d]
    return out


def _merged(spans) -> list[tuple[int, int, int]]:
    """Union of (start, end, partner); the least partner stays."""
    out: list[list[int]] = []
    for s, e, p in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], e), min(out[-1][2], p)
        else:
            out.append([s, e, p])
    return [tuple(x) for x in out]


def common_passages(a: np.ndarray, b: np.ndarray, windows_a, windows_b) -> list[tuple[int, int, int, int]]:
    """(start, end in a, start, end in b) in words, of the verified passages of two texts (short shingle hashes)."""
    return passages_of_pairs([(a, b, windows_a, windows_b)])[0]


def passages_of_pairs(texts: list[tuple]) -> list[list[tuple[int, int, int, int]]]:
    """``common_passages`` of every (a, b, windows of a, windows of b)."""
    out: list[list] = [[] for _ in texts]
    sides = []
    for side in (2, 3):
        windows = np.concatenate([t[side] for t in texts])
        pair = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t[side]) for t in texts])
        sides += [windows, (pair << _U(32)) | windows["value"]]
    x, keys_a, y, keys_b = sides
    low = np.searchsorted(keys_b, keys_a, "left")
    many = np.searchsorted(keys_b, keys_a, "right") - low
    if len(texts) > 1 and many.sum() > 16 * WINDOWS:  # lines that repeat within texts
        half = len(texts) // 2
        return passages_of_pairs(texts[:half]) + passages_of_pairs(texts[half:])
    at_a = np.repeat(np.arange(len(x)), many)
    at_b = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(at_a))
    d = y["c"][at_b] - x["c"][at_a]
    first = np.maximum(x["first"][at_a], y["first"][at_b] - d)
    last = np.minimum(x["last"][at_a], y["last"][at_b] - d)
    meet = np.flatnonzero(first <= last)
    if not len(meet):
        return out
    place = ((keys_a[at_a[meet]] >> _U(32)).astype(np.int64) << 32) + d[meet]  # by pair and diagonal
    order = np.argsort(place, kind="stable")
    place, meet = place[order], meet[order]
    d, first, last = (v[meet].astype(np.int64) for v in (d, first, last))
    function = (x["value"][at_a[meet]] & 3).astype(np.int64)
    # groups of near diagonals of a pair
    group = np.append(0, np.cumsum(np.diff(place) > SLACK))
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    stop = np.append(start[1:], len(d))
    pair = (place[start] - d[start]) >> 32
    low = np.minimum.reduceat(first, start)
    width = np.maximum.reduceat(last, start) - low + 2
    reach = np.cumsum(width)
    k = 0
    while k < len(start):
        # the first words of the passages of some groups, one group after the other
        m = max(k + 1, int(np.searchsorted(reach, reach[k] - width[k] + PLACES, "right")))
        begin, votes = reach[k:m] - width[k:m] - (reach[k] - width[k]), slice(start[k], stop[m - 1])
        total = int(reach[m - 1] - reach[k] + width[k])
        at = function[votes] * total + (begin - low[k:m])[group[votes] - k]
        seen = np.bincount(at + first[votes], minlength=HASHES * total)
        seen -= np.bincount(at + last[votes] + 1, minlength=HASHES * total)
        enough = np.count_nonzero(np.cumsum(seen.reshape(HASHES, total), axis=1), axis=0) >= ENOUGH
        for i in np.flatnonzero(np.logical_or.reduceat(enough, begin)).tolist():
            a, b = texts[pair[k + i]][:2]
            own = d[start[k + i] : stop[k + i]]
            held = enough[begin[i] : begin[i] + width[k + i]]
            out[pair[k + i]] += _agreeing(a, b, int(low[k + i]), held, own)
        k = m
    return out


def _agreeing(a: np.ndarray, b: np.ndarray, low: int, held: np.ndarray, votes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The verified ones of the passages that start at ``held`` places from ``low`` on, along some of the sorted diagonals."""
    inner = np.flatnonzero(held)
    low, held = low + int(inner[0]), held[inner[0] : inner[-1] + 1]
    middle = int(votes[len(votes) // 2])
    others = [v for v in votes[np.append(True, votes[1:] != votes[:-1])].tolist() if v != middle]
    good, sums = np.zeros(len(held), bool), np.zeros(len(held) + SPAN, np.int32)
    part = a[low : low + len(held) + SPAN - 1]
    for diagonal in [middle, *others]:
        np.cumsum(_matches(part, b, diagonal + low), out=sums[1:])
        good |= sums[SPAN:] - sums[:-SPAN] >= MATCHING
        if diagonal == middle and (good | ~held).all():
            break
    good &= held
    edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
    n, out = len(b) + SHINGLE - 1, []
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
        start, end = low + s, low + e - 1 + WORDS
        out.append((start, end, max(0, start + middle), min(n, end + middle)))
    return out


def _texts(documents: DataFrame) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(n, own) for n, own, _ in shingle_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([o for _, o in rows], pa.int64())],
                names=["doc_id", "n_words", "text_id"],
            )

    rows = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, text_id long").filter(F.col("n_words") >= WORDS).distinct()


def _fetch(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """text_id, shingles in order and compact windows, for the wanted (doc_id, text_id).

    Shingles are compared place by place from here on, for which 16 bits of their hashes are enough: of the
    ``SPAN`` comparisons of a passage, a wrong one has a chance of 1 in 13 000.
    """
    rows = documents.select("doc_id", "text").join(small_side(wanted), "doc_id").select("text", "text_id")

    def run(batches):
        def out(rows):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["text_id", "tokens", "windows"])

        for batch in batches:
            rows, held, wanted = [], 0, batch.column(1).to_numpy()
            for places, ids, tokens, borders in shingled(batch.column(0)):
                short = (tokens & _U(0xFFFF)).astype("<u2")
                tables = window_tables(tokens, borders)
                for want, own, windows, i, j in zip(wanted[places], ids, tables, borders[:-1], borders[1:]):
                    if own == want:
                        rows.append((own, short[i:j].tobytes(), windows.tobytes()))
                        held += 4 * int(j - i)
                    if held > 1 << 24:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)

    return rows.mapInArrow(run, "text_id long, tokens binary, windows binary")


def _verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(text_id, start, end, partner) spans of both sides of the pairs, merged within a task."""
    left = tokens.select(F.col("text_id").alias("a"), F.col("tokens").alias("ta"), F.col("windows").alias("wa"))
    right = tokens.select(F.col("text_id").alias("b"), F.col("tokens").alias("tb"), F.col("windows").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb", "wa", "wb")

    def run(batches):
        spans: dict[int, list] = {}
        for batch in batches:
            ids, texts, held = [], [], 0
            columns = [batch.column(i) for i in range(2, 6)]
            for k, (a, b, *raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *columns), 1):
                xa, xb = (np.frombuffer(x.as_buffer(), "<u2") for x in raw[:2])
                wa, wb = (np.frombuffer(x.as_buffer(), _WINDOW) for x in raw[2:])
                ids.append((a, b))
                texts.append((xa, xb, wa, wb))
                held += len(wa) + len(wb)
                if held < WINDOWS and k < batch.num_rows:
                    continue
                for (own, other), found in zip(ids, passages_of_pairs(texts)):
                    if found:
                        spans.setdefault(own, []).extend((s, e, other) for s, e, _, _ in found)
                        spans.setdefault(other, []).extend((s, e, own) for _, _, s, e in found)
                ids, texts, held = [], [], 0
            for own, found in spans.items():
                if len(found) > 100:
                    spans[own] = _merged(found)
        rows = [(own, *x) for own, found in spans.items() for x in _merged(found)]
        for k in range(0, len(rows), 50_000):
            part = list(zip(*rows[k : k + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], names=["text_id", "start", "end", "partner"])

    return both.mapInArrow(run, "text_id long, start long, end long, partner long")


#: Places around the least shingle that its passages can reach, with drift.
_REACH = SPAN - 1 + SLACK
#: Pairs of occurrences that a task compares at once.
PAIRS = 1 << 10
_OCCURRENCE = "key long, n long, text_id long, open boolean, first long, last long, c long, around binary"


def _hot_occurrences(held: DataFrame, tokens: DataFrame, spans: DataFrame, open_only: bool) -> DataFrame:
    """The occurrences of the (key, n, text_id) in ``held``; ``open``: some passage of it lies in no span of its text."""
    wanted = held.groupBy("text_id").agg(F.collect_list(F.struct("key", "n")).alias("keys"))
    rows = wanted.join(tokens, "text_id").join(spans, "text_id", "left").select("text_id", "keys", "tokens", "windows", "spans")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _OCCURRENCE.split(", ")]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        for batch in batches:
            out = []
            for own, listed, tokens, windows, spans in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in range(1, 5))):
                wanted, sizes = (listed.values.field(i).to_numpy() for i in range(2))
                order = np.argsort(wanted)
                wanted, sizes = wanted[order], sizes[order]
                tokens = np.frombuffer(tokens.as_buffer(), "<u2")
                key, first, last, c = occurrences(np.frombuffer(windows.as_buffer(), _WINDOW))
                key = key.view(np.int64)
                place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                outside = np.ones(len(tokens), np.int64)  # passages by first word
                for s, e, _ in _merged((x["start"], x["end"], 0) for x in spans.as_py() or ()):
                    outside[s : max(s, e - WORDS + 1)] = 0
                upto = np.append(0, np.cumsum(outside))
                is_open = upto[last + 1] > upto[first]
                take = (wanted[place] == key) & (is_open | (not open_only))
                padded = np.pad(tokens, _REACH)
                for i in np.flatnonzero(take):
                    around = b"" if open_only else padded[c[i] : c[i] + 2 * _REACH + 1].tobytes()
                    out.append((key[i], sizes[place[i]], own, is_open[i], first[i], last[i], c[i], around))
                if len(out) > 10_000:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    return rows.mapInArrow(run, _OCCURRENCE)


def uncovered_spans(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
    """(text_id, start, end, partner) of the open occurrences of a bucket, or of two blocks of one, against the others.

    Rows: text_id, block, open, first, last, c, around. Rows of two blocks are compared across the blocks alone.
    """
    ids, blocks = (np.array([r[i] for r in rows], np.int64) for i in range(2))
    two = len(np.unique(blocks)) > 1
    around = np.frombuffer(b"".join(r[6] for r in rows), "<u2").reshape(len(rows), -1)
    first, last, c = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5))
    low, many = first - c + SPAN - 1, last - first + 1
    opened, out = np.flatnonzero([r[2] for r in rows]), []
    step = max(1, PAIRS // len(rows))
    for k in range(0, len(opened), step):
        part = opened[k : k + step]
        other = ids[part, None] != ids
        if two:
            other &= blocks[part, None] != blocks
        own, rest = np.nonzero(other)
        own = part[own]
        # the shingles of all passages of this part
        begin, starts = int(low[part].min()), int((low + many)[part].max() - low[part].min())
        width = starts + SPAN - 1
        match = np.zeros((len(own), width), bool)
        mine, theirs = around[own, begin + SLACK : begin + SLACK + width], around[rest, begin : begin + width + 2 * SLACK]
        for drift in range(2 * SLACK + 1):
            match |= theirs[:, drift : drift + width] == mine
        near = np.flatnonzero(np.count_nonzero(match, axis=1) >= MATCHING)
        own, rest = own[near], rest[near]
        sums = np.zeros((len(near), width + 1), np.int16)
        np.cumsum(match[near], axis=1, out=sums[:, 1:])
        good = sums[:, SPAN:] - sums[:, :starts] >= MATCHING
        inside = np.arange(begin, begin + starts) - low[own, None]
        good &= (inside >= 0) & (inside < many[own, None])
        hit = np.flatnonzero(good.any(axis=1))
        own, rest, good = own[hit], rest[hit], good[hit]
        border = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)) if len(own) else [0]
        for i, j in zip(border[:-1], border[1:]):
            r, g, others = int(own[i]), good[i:j], ids[rest[i:j]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.any(axis=0).astype(np.int8), [0]])))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                at = int(c[r]) - SPAN + 1 + begin
                out.append((int(ids[r]), at + s, at + e - 1 + WORDS, int(others[g[:, s:e].any(axis=1)].min())))
    return out


def _second_round(found: DataFrame, members: DataFrame, ends: DataFrame, tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """(text_id, start, end, partner) spans of what ``found`` leaves uncovered in buckets of four texts or more."""
    spans = found.groupBy("text_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = scratch.stored(spans, "span-lists")
    hot = scratch.stored(members.join(ends.filter("n > 3").select("key", "n"), "key"), "hot")
    left = scratch.stored(_hot_occurrences(hot, tokens, spans, True).select("key").distinct(), "open-keys", 1000)
    rows = _hot_occurrences(hot.join(left, "key"), tokens, spans, False)
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("group", F.least("block", "__o")).withColumn("other", F.greatest("block", "__o"))
    rows = rows.select("key", "group", "other", "text_id", "block", "open", "first", "last", "c", "around")
    laid = rows.repartition("key", "group", "other").sortWithinPartitions("key", "group", "other", "text_id", "first")

    def run(batches):
        spans = []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in spans], pa.int64()) for i in range(4)], names=["text_id", "start", "end", "partner"])

        for group in _runs(batches, 3):
            # one of two blocks may be empty
            if group[0][1] == group[0][2] or len({r[4] for r in group}) > 1:
                spans += uncovered_spans([r[3:] for r in group])
            if len(spans) > 50_000:
                yield made()
                spans = []
        yield made()

    return laid.mapInArrow(run, "text_id long, start long, end long, partner long")


def repeated_passages(documents: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, partner_doc_id) for every span that is repeated in another document."""
    texts = stored(_texts(documents), "texts", 2000)
    classes = stored(
        texts.groupBy("text_id").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("n_words").alias("n_words")), "text-classes"
    )
    with Scratch(documents.sparkSession) as scratch:
        members = scratch.stored(shared_keys(key_rows(documents.filter(F.col("doc_id").isNotNull()), keyed_texts)).withColumnRenamed("set_id", "text_id"), "anchors", 4000)
        ends = members.groupBy("key").agg(F.min("text_id").alias("first"), F.max("text_id").alias("last"), F.count(F.lit(1)).alias("n"))
        other = F.explode(F.array_distinct(F.array("first", "last"))).alias("other")
        pairs = members.join(ends, "key").select("text_id", other).filter("text_id <> other")
        pairs = pairs.select(F.least("text_id", "other").alias("a"), F.greatest("text_id", "other").alias("b")).distinct()
        pairs = scratch.stored(pairs, "passage-pairs")
        wanted = pairs.select(F.col("a").alias("text_id")).union(pairs.select("b")).distinct()
        wanted = scratch.stored(wanted.join(classes, "text_id").select(F.col("low").alias("doc_id"), "text_id"), "wanted")
        tokens = scratch.stored(_fetch(documents, wanted), "shingles", 1000)
        found = stored(_verified(pairs, tokens), "spans", 1000)
        found = found.unionByName(stored(_second_round(found, members, ends, tokens, scratch), "more-spans", 1000))
    partner = classes.select(F.col("text_id").alias("partner"), F.col("low").alias("partner_doc"))
    found = found.join(partner, "partner").select("text_id", F.struct("start", "end", F.col("partner_doc").alias("partner")).alias("span"))
    # a task gives a text's spans merged, so this gathers a few spans a task
    lists = found.groupBy("text_id").agg(F.collect_list("span").alias("spans"))

    def merge(batches):
        for batch in batches:
            out = []
            for own, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(own, *s) for s in _merged((x["start"], x["end"], x["partner"]) for x in spans)]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["text_id", "start_word", "end_word", "partner_doc_id"])

    near = lists.mapInArrow(merge, "text_id long, start_word long, end_word long, partner_doc_id long")
    copies = classes.filter("low <> high").select("text_id", "low", "high", "n_words")
    whole = texts.select("doc_id", "text_id").join(small_side(stored(copies, "copies")), "text_id").select(
        "doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"),
        F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("partner_doc_id"),
    )
    single = texts.join(classes.filter("low = high").select("text_id"), "text_id", "left_semi").select("doc_id", "text_id")
    spread = single.join(near, "text_id").select("doc_id", "start_word", "end_word", "partner_doc_id")
    return whole.unionByName(spread)

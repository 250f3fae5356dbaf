"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct ``SHINGLE``-word shingles (the whole sequence when it has fewer words). Two
documents link when ``100 * |A & B| >= PERCENT * |A | B|``. Documents with equal sets form a class; classes are
joined as follows, and components are taken over the links found.

* **Sketch.** Shingles are dealt to S segments by hash; a segment holds the XOR of the hashes of its shingles.
  A shingle in only one of two sets changes one segment, so the number of differing segments is at most
  |A ^ B|, and a link allows at most D = 15/185 * (|A| + |B|).
* **Bands.** A band covers a range of sizes such that every pair that can link falls into one, and has its own
  D and S. With S = D + r, at least r segments of a linked pair agree (pigeonhole), and agreeing segments are
  equi-join keys. Empty segments say nothing, so they are no keys, except for the rare document with r or
  more of them: if all agreeing segments of a pair are empty, both documents are of that kind.
* **Small sets** (up to 12 shingles, D = 1): the keys are the XOR of all shingles and of all but one, which
  agree for some choice in every linked pair. Sets of up to 5 only link when equal.
* **Buckets.** Only keys held by two classes or more go on. Equal keys within a task are found there, so
  the shuffle gets at most one row per key and task; a bucket with the same members as another is dropped.
* **Forest.** In a bucket, pairs are held against a one-bit-per-shingle parity sketch, whose Hamming distance
  is a lower bound on |A ^ B|. Of the pairs that pass only a spanning forest is verified. Buckets of more than
  ``BLOCK`` members are split, a block meeting the next. If verification refutes an edge, or a bucket has blocks that
  did not meet (four or more), a second round compares what is still apart in the same bucket, block by block, so no
  link between components is lost.

Shingles are 64-bit hashes; a class is known by a 64-bit hash of its set.

Null, empty and wordless texts have no shingles and link with nothing. Rows that repeat a doc_id each get a
row; a row without doc_id gets a component only through classes with a doc_id. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.sizing import BROADCAST_BYTES, fits_broadcast
from .components import components
from .kernels import FOLDED_VALUES, NONSPACE, gram_hashes, mix, release, span_hashes, text_slices, words
from .store import Scratch, stored

SHINGLE = 4
PERCENT = 85
BLOCK = 2048
WIDTH = 1.4  # ratio of the largest to the smallest size of a band
SMALL = 12
_U = np.uint64


def shingle_sets(column: pa.Array):
    """Sorted distinct shingle hashes of every text."""
    for i, j, data, offsets in text_slices(column):
        starts, ends, at = words(data, offsets, NONSPACE)
        hashes = span_hashes(data, starts, ends, FOLDED_VALUES)
        grams = gram_hashes(hashes, SHINGLE)
        for k in range(j - i):
            a, b = int(at[k]), int(at[k + 1])
            if b - a >= SHINGLE:
                own = np.sort(grams[a : b - SHINGLE + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            else:
                yield gram_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    total = tokens.sum(dtype=np.uint64, keepdims=True)
    return int(mix(total ^ mix(np.full(1, len(tokens), np.uint64))).view(np.int64)[0])


def most_different(size: int) -> int:
    """Largest |A ^ B| of a linked pair with |A| + |B| = size."""
    return (100 - PERCENT) * size // (100 + PERCENT)


def largest_partner(size: int) -> int:
    return 100 * size // PERCENT


@lru_cache(maxsize=None)
def band(number: int) -> tuple[int, int, int, int]:
    """(least size, largest size, segments, empty segments from which on they are keys)."""
    if number == 0:
        low = SMALL
    else:
        # the band before holds every pair whose smaller size is below this
        reach = band(number - 1)[1]
        low = next(s for s in range(reach, 0, -1) if largest_partner(s) <= reach) + 1
    high = max(int(low * WIDTH), largest_partner(low))
    different = most_different(2 * high)
    spare, last = 1, 1.0
    while True:
        segments = different + spare
        empty = segments * math.exp(-low / segments)
        tail = 1 - sum(math.exp(-empty) * empty**i / math.factorial(i) for i in range(spare))
        if tail < 1e-3 or (tail > 0.8 * last and spare > 1):
            break
        spare, last = spare + 1, tail
    return low, high, segments, spare


def bands_of(size: int) -> list[int]:
    out, number = [], max(0, int(math.log(max(size, SMALL) / SMALL) / math.log(WIDTH)) - 2)
    while band(number)[0] <= size:
        if size <= band(number)[1]:
            out.append(number)
        number += 1
    return out


@lru_cache(maxsize=256)
def _edges(segments: int) -> np.ndarray:
    return np.array([(i << 64) // segments for i in range(1, segments)], np.uint64)


@lru_cache(maxsize=None)
def _names(number: int) -> np.ndarray:
    return mix((np.arange(band(number)[2], dtype=np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93) + _U(number))


def keys(tokens: np.ndarray) -> np.ndarray:
    """Join keys of a set (sorted, distinct); linked sets that differ share one at least."""
    n, out = len(tokens), []
    if n < 6:
        return np.zeros(0, np.uint64)
    mixed = mix(tokens + _U(0x632BE59BD9B4E019))
    if n <= SMALL:
        whole = np.bitwise_xor.reduce(mixed)
        out.append(mix(np.append(whole, whole ^ mixed)))
    if n >= SMALL:
        parity = np.zeros(n + 1, np.uint64)
        np.bitwise_xor.accumulate(mixed, out=parity[1:])
        for number in bands_of(n):
            _, _, segments, spare = band(number)
            at = np.empty(segments + 1, np.int64)
            at[0], at[-1] = 0, n
            at[1:-1] = np.searchsorted(tokens, _edges(segments))
            full = at[1:] > at[:-1]
            if segments - int(full.sum()) >= spare:
                full[:] = True
            own = parity[at[1:]] ^ parity[at[:-1]]
            out.append(mix(own[full] + _names(number)[full]))
    return np.concatenate(out)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One-bit-per-shingle parity sketch: at least two bits a shingle, a power of two."""
    bits = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    place = (mix(tokens + _U(0xA0761D6478BD642F)) & _U(bits - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketches: np.ndarray, n_words: int) -> np.ndarray:
    while len(sketches) > n_words:
        half = len(sketches) // 2
        sketches = sketches[:half] ^ sketches[half:]
    return sketches


def forest(ids: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], apart: np.ndarray | None = None, across: np.ndarray | None = None):
    """Pairs (i, j) to verify among the members of a bucket.

    Without ``apart``: a spanning forest of the pairs that may link, near pairs first. With ``apart`` (component
    numbers) every pair of different components that may link. ``across``: block numbers; pairs within block 1 are
    another group's work in the second round.
    """
    n_words = min(len(s) for s in sketches)
    table = np.stack([folded(s, n_words) for s in sketches])
    pairs = []

    def distance(i, rest):
        return np.bitwise_count(table[rest] ^ table[i]).sum(axis=1)

    def most(i, rest):
        return (100 - PERCENT) * (sizes[rest] + sizes[i]) // (100 + PERCENT)

    def fits(i, rest):
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        return 100 * small >= PERCENT * large

    if apart is not None:
        for i in range(len(ids) - 1):
            rest = np.arange(i + 1, len(ids))
            rest = rest[(apart[rest] != apart[i]) & (ids[rest] != ids[i])]
            if across is not None:
                rest = rest[across[rest] != across[i]]
            rest = rest[fits(i, rest)]
            rest = rest[distance(i, rest) <= most(i, rest)]
            pairs += [(i, int(j)) for j in rest]
        return pairs
    left = np.arange(len(ids))
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        unsure_of = np.full(len(ids), -1)  # the joined member that is nearest to a waiting one
        unsure_at = np.full(len(ids), np.iinfo(np.int64).max)
        while len(left):
            if frontier:
                i = frontier.pop()
                d, limit = distance(i, left), most(i, left)
                may = (d <= limit) & fits(i, left)
                sure = may & (100 * d <= 80 * limit)
                for j in left[sure]:
                    pairs.append((i, int(j)))
                    frontier.append(int(j))
                waiting = left[may & ~sure]
                nearer = waiting[d[may & ~sure] < unsure_at[waiting]]
                unsure_of[nearer], unsure_at[nearer] = i, d[np.isin(left, nearer)]
                left = left[~sure]
            else:
                best = left[unsure_at[left].argmin()]
                if unsure_of[best] < 0:
                    break
                pairs.append((int(unsure_of[best]), int(best)))
                frontier.append(int(best))
                left = left[left != best]
    return pairs


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (null for an empty set)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = [(len(s), set_id(s) if len(s) else None) for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array([s for _, s in sets], pa.int64())],
                names=["doc_id", "n_shingles", "set_id"],
            )
        release()

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_id long")


def keyed_sets(column: pa.Array):
    """(set_id, keys) of the sets that can link with a different one."""
    for tokens in shingle_sets(column):
        if len(tokens) >= 6:
            yield set_id(tokens), lambda tokens=tokens: np.unique(keys(tokens))


def key_rows(documents: DataFrame, keyed) -> DataFrame:
    """key, set_id; the two low bits of the key are 0: alone in its task, 1: first of several there, 2: another one.

    ``keyed`` gives (id, function that makes the distinct keys) for the texts of a column.
    """
    hold = 1 << 18

    def run(batches):
        seen, held, count = set(), [], 0

        def out():
            key = np.concatenate([k for _, k in held]) & ~_U(3)
            own = np.repeat(np.array([s for s, _ in held], np.int64), [len(k) for _, k in held])
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            first = np.append(True, key[1:] != key[:-1])
            several = np.repeat(np.diff(np.append(np.flatnonzero(first), len(key))) > 1, np.diff(np.append(np.flatnonzero(first), len(key))))
            key |= np.where(several, np.where(first, 1, 2), 0).astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own)], names=["key", "set_id"])

        for batch in batches:
            for own, made in keyed(batch.column(0)):
                if own in seen:
                    continue
                seen.add(own)
                held.append((own, made()))
                count += len(held[-1][1])
                if count >= hold:
                    yield out()
                    held, count = [], 0
        if held:
            yield out()
        seen, held = set(), []
        release()

    return documents.select("text").mapInArrow(run, "key long, set_id long")


def shared_keys(rows: DataFrame) -> DataFrame:
    """Distinct (key, set_id) of keys that two classes or more hold; a class comes in once a task that holds it."""
    bare = F.col("key").bitwiseAND(F.lit(-4))
    # rows that need no partner any more are spread by their class
    home = F.when(F.col("key").bitwiseAND(F.lit(3)) == 2, F.col("set_id")).otherwise(bare)
    laid = rows.repartition(home).sortWithinPartitions(home, "set_id")

    def run(batches):
        # the last row stays open until the next key: (key, set, kind, already given out)
        held = None
        for batch in batches:
            marked, own = (batch.column(i).to_numpy() for i in range(2))
            key, kind = marked & ~np.int64(3), (marked & 3).astype(np.int8)
            direct = kind == 2
            out_key, out_own = [key[direct]], [own[direct]]
            key, own, kind = key[~direct], own[~direct], kind[~direct]
            given = np.zeros(len(key), bool)
            if held:
                key, own, kind = np.append(held[0], key), np.append(held[1], own), np.append(np.int8(held[2]), kind)
                given = np.append(held[3], given)
            if len(key):
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                fresh = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
                length = np.diff(np.append(first, len(key)))
                several = (np.add.reduceat(fresh.astype(np.int64), first) > 1) | (np.maximum.reduceat(kind, first) > 0)
                several |= np.logical_or.reduceat(given, first)
                out = np.repeat(several, length) & fresh & ~given
                out_key.append(key[out])
                out_own.append(own[out])
                held = (key[-1], own[-1], kind[first[-1] :].max(), bool(several[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_key)), pa.array(np.concatenate(out_own))], names=["key", "set_id"])

    return laid.mapInArrow(run, "key long, set_id long").distinct()


def _without_twins(members: DataFrame) -> DataFrame:
    """One bucket of those with the same members (distinct rows): equal counts and equal sums of two hashes of theirs."""
    half = F.lit((1 << 32) - 1)
    hashes = F.xxhash64("set_id"), F.xxhash64("set_id", F.lit(1))
    sums = [F.sum(x) for h in hashes for x in (h.bitwiseAND(half), F.shiftrightunsigned(h, 32))]
    marks = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"mark{i}") for i, x in enumerate(sums)])
    chosen = marks.groupBy("n", *[f"mark{i}" for i in range(len(sums))]).agg(F.min("key").alias("key"))
    return members.join(chosen.select("key", "n"), "key")


def small_side(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if fits_broadcast(table, BROADCAST_BYTES) else table


def _fetch(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id, n, tokens, sketch of the wanted (doc_id, set_id)."""
    rows = documents.select("doc_id", "text").join(small_side(wanted), "doc_id").select("text", "set_id")

    def run(batches):
        for batch in batches:
            out = [(w, t) for w, t in zip(batch.column(1).to_pylist(), shingle_sets(batch.column(0))) if set_id(t) == w]
            for k in range(0, len(out), 1000):
                part = out[k : k + 1000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w for w, _ in part], pa.int64()),
                        pa.array([len(t) for _, t in part], pa.int64()),
                        pa.array([t.tobytes() for _, t in part], pa.binary()),
                        pa.array([sketch(t).tobytes() for _, t in part], pa.binary()),
                    ],
                    names=["set_id", "n", "tokens", "sketch"],
                )

    return rows.mapInArrow(run, "set_id long, n long, tokens binary, sketch binary")


def _runs(batches, columns: int):
    """Rows of one group after another, from batches sorted by the first column(s) ``columns``."""
    held, at = [], None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols):
            if row[:columns] != at:
                if held:
                    yield held
                held, at = [], row[:columns]
            held.append(row)
    if held:
        yield held


def _pairs(buckets: DataFrame, first_round: bool) -> DataFrame:
    """(a, b) to verify; ``buckets``: key, set_id, n (members), size, sketch and, later, component."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    rows = buckets.withColumn("blocks", blocks).withColumn("block", block)
    if first_round:
        ring = F.array_distinct(F.array(F.col("block"), F.pmod(F.col("block") - 1, F.col("blocks"))))
        rows = rows.withColumn("group", F.explode(ring)).withColumn("other", F.lit(-1)).withColumn("component", F.lit(0).cast("long"))
    else:
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        rows = rows.withColumn("__o", each).withColumn("group", F.least("block", "__o")).withColumn("other", F.greatest("block", "__o")).drop("__o")
    names = ["key", "group", "other", "block", "set_id", "size", "component", "sketch"]
    laid = rows.select(*names).repartition("key", "group", "other").sortWithinPartitions("key", "group", "other", "set_id")

    def run(batches):
        out_a, out_b = [], []
        for rows in _runs(batches, 3):
            if len(rows) < 2:
                continue
            ids = np.array([r[4] for r in rows], np.int64)
            sizes = np.array([r[5] for r in rows], np.int64)
            marks = [np.frombuffer(r[7], np.uint64) for r in rows]
            if first_round:
                found = forest(ids, sizes, marks)
            else:
                _, apart = np.unique([r[6] for r in rows], return_inverse=True)
                across = np.array([r[3] for r in rows]) if rows[0][1] != rows[0][2] else None
                found = forest(ids, sizes, marks, apart, across)
            for i, j in found:
                if ids[i] != ids[j]:
                    out_a.append(min(ids[i], ids[j]))
                    out_b.append(max(ids[i], ids[j]))
            if len(out_a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
                out_a, out_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return laid.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(a, b, linked) by exact comparison of the sets."""
    left = tokens.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta"))
    right = tokens.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], names=["a", "b", "linked"])

    return both.mapInArrow(run, "a long, b long, linked boolean")


def link_classes(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links (a, b) between classes (set_id, doc_id), enough for their components."""
    with Scratch(documents.sparkSession) as scratch:
        return _links(documents, classes, scratch)


def _links(documents: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    members = scratch.stored(shared_keys(key_rows(documents, keyed_sets)), "keys", 2000)
    members = scratch.stored(_without_twins(members), "buckets")
    wanted = members.select("set_id").distinct().join(classes, "set_id").select("doc_id", "set_id")
    tokens = scratch.stored(_fetch(documents, scratch.stored(wanted, "wanted")), "sets", 1000)
    sized = tokens.select("set_id", F.col("n").alias("size"), "sketch")
    buckets = members.join(sized, "set_id")
    tried = stored(_verified(_pairs(buckets, True), tokens), "links", 1000)
    links = tried.filter("linked").select("a", "b")
    unmet = F.col("n") > 3 * BLOCK  # in the ring of the first round not every block meets every other
    if tried.filter("NOT linked").isEmpty() and members.filter(unmet).isEmpty():
        return links
    # what is still apart in a bucket is compared as a whole
    found = components(links)
    labelled = members.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    labelled = scratch.stored(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    pairs = _pairs(labelled.join(mixed, "key").join(sized, "set_id"), False)
    again = _verified(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), tokens)
    return links.unionByName(stored(again.filter("linked").select("a", "b"), "more-links", 1000))


def join(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles long, set_id long (class), component_id (least linked doc_id)."""
    digest = stored(digests(documents), "digests", 2000)
    classes = stored(digest.filter("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("doc_id")), "classes")
    found = components(link_classes(documents, classes)).withColumnRenamed("node", "set_id")
    labelled = classes.join(found, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stored(labelled.join(least, "component").select("set_id", "component_id"), "named")
    return digest.join(small_side(named), "set_id", "left").select(
        "doc_id", "n_shingles", "set_id", F.coalesce("component_id", "doc_id").alias("component_id")
    )

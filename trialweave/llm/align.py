"""Alignment of two tokenizers over a corpus, each distinct text once.

``distinct_texts`` shuffles documents by their full text; every distinct text is tokenised and aligned once
(``aligned``), and its pair counts weigh as often as it occurs (``pair_counts``). ``measured_documents`` looks the counts
up again for every link of a text and joins the measures to the doc_ids.

Both tokenizers read a space and the text: A (a byte-level ``tokenizers`` file) is given the space, B (a
``sentencepiece`` model) adds it. The bytes of a token are A's entry byte-level decoded, or B's piece with U+2581 as a
space and <0xHH> as that byte. Offsets where tokens of both sides end cut them into *groups*; a *link* is an A token and
a B token with overlapping bytes. Special tokens' strings in texts are ordinary text.

A text whose tokens do not join to its bytes on both sides has no tokens, like a null or empty one: zeros and no
digest. Repeated rows are documents of their own, whatever their doc_id; an empty table gives no rows; other columns
are ignored. Equal highest counts of a B id are all highest. Texts are handled in slices of ``SLICE`` bytes, a longer
text alone.

Looking up counts needs no bound on their number: the at most ``FREQUENT`` most frequent pairs are broadcast, and what
is not among them goes to a join by pair, in which no pair has more than about 2 / ``FREQUENT`` of all links.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .kernels import text_slices
from .lookups import looked_up
from .store import Scratch, stored
from .token_store import Encoder

FREQUENT = 1 << 20
SLICE = 1 << 19
#: Pairs a task adds up before it hands them on.
HELD = 1 << 21


class _Pieces:
    """A sentencepiece model with the calls of a ``tokenizers`` one; texts begin with the space that the model adds."""

    def __init__(self, model):
        self.model = model
        self.space = [model.piece_to_id("▁")]  # the model adds no space to an empty text

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False):
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [SimpleNamespace(ids=self.space if t == " " else ids) for t, ids in zip(texts, found)]


class PieceEncoder(Encoder):
    """``Encoder`` of a sentencepiece model, for texts that begin with a space.

    Where no piece has a space after another character, no merge crosses the beginning of a run of spaces, so texts may
    be cut there.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokenizer = _Pieces(model)
        self.vocabulary = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.vocabulary)]
        self.uncut = "▁" not in self.pieces or any("▁" in p.lstrip("▁") for p in self.pieces)
        self.added = []
        self._forget()

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        if self.uncut:
            return np.zeros(0, np.int64)
        return np.flatnonzero((data[1:] == 32) & (data[:-1] != 32)) + 1

    def token_bytes(self) -> list[bytes]:
        out = []
        for i, piece in enumerate(self.pieces):
            if self.tokenizer.model.is_byte(i):
                out.append(bytes([int(piece[3:5], 16)]))
            else:
                out.append(piece.replace("▁", " ").encode())
        return out


def byte_level_tokens(encoder: Encoder) -> list[bytes]:
    """Bytes of the ids of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes for U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    out = [b""] * encoder.vocabulary
    for token, i in encoder.tokenizer.get_vocab(with_added_tokens=False).items():
        out[i] = bytes(byte_of[c] for c in token)
    return out


class _Table:
    """Byte strings by number."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.length = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.length) - self.length

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ``ids`` one after another, and where each ends."""
        count = self.length[ids]
        ends = np.cumsum(count)
        if not len(ids):
            return np.zeros(0, np.uint8), ends
        return self.flat[np.repeat(self.start[ids] - (ends - count), count) + np.arange(ends[-1])], ends


@dataclass
class Side:
    encoder: Encoder
    table: _Table


class Aligner:
    """Both tokenizers; one per Python worker."""

    @staticmethod
    @lru_cache(2)
    def of(path_a: str, path_b: str) -> Aligner:
        return Aligner(path_a, path_b)

    def __init__(self, path_a: str, path_b: str):
        a, b = Encoder(path_a), PieceEncoder(path_b)
        self.a, self.b = Side(a, _Table(byte_level_tokens(a))), Side(b, _Table(b.token_bytes()))
        self.scale = b.vocabulary
        self.code = code_type(a.vocabulary, b.vocabulary)
        # every number with room for the mark that follows it
        self.numbers = _Table([b"%d?" % i for i in range(max(a.vocabulary, b.vocabulary))])

    def _tokens(self, side: Side, data: np.ndarray, offsets: np.ndarray):
        """Ids, their number per text, and whether they join to the text."""
        ids, count = side.encoder.encode(data, offsets)
        joined, ends = side.table.joined(ids)
        borders = np.append(0, ends)[np.append(0, np.cumsum(count))]
        good = np.diff(borders) == np.diff(offsets)
        if good.all():
            differs = np.flatnonzero(joined != data)
            good[np.searchsorted(offsets, differs, "right") - 1] = False
        else:
            for t in np.flatnonzero(good):
                good[t] = np.array_equal(joined[borders[t] : borders[t + 1]], data[offsets[t] : offsets[t + 1]])
        return ids, count, good

    def align(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, groups_sha256, pair codes, times per text (each beginning with its space)."""
        n = len(offsets) - 1
        ids_a, count_a, good = self._tokens(self.a, data, offsets)
        ids_b, count_b, good_b = self._tokens(self.b, data, offsets)
        good &= good_b
        ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
        count_a, count_b = np.where(good, count_a, 0), np.where(good, count_b, 0)
        size = np.where(good, np.diff(offsets), 0)
        total, text_ends = int(size.sum()), np.cumsum(size)
        ends_a, ends_b = np.cumsum(self.a.table.length[ids_a]), np.cumsum(self.b.table.length[ids_b])
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[ends_a], is_b[ends_b] = True, True
        both = is_a & is_b
        cuts = np.flatnonzero(is_a | is_b)  # every stretch between cuts is one link
        at_a, at_b, shared = is_a[cuts], is_b[cuts], both[cuts]
        codes = ids_a[np.cumsum(at_a) - at_a].astype(np.uint64) * np.uint64(self.scale) + ids_b[np.cumsum(at_b) - at_b]
        text_of = np.searchsorted(text_ends, cuts, "left")
        n_links, n_groups = np.bincount(text_of, minlength=n), np.bincount(text_of[shared], minlength=n)
        digests = self._digests(ids_a, ids_b, ends_a, ends_b, both, count_a + count_b)
        order = np.lexsort((codes, text_of))
        codes, text_of = codes[order], text_of[order]
        first = np.ones(len(codes), bool)
        first[1:] = (codes[1:] != codes[:-1]) | (text_of[1:] != text_of[:-1])
        places = np.flatnonzero(first)
        times = np.diff(np.append(places, len(codes))).astype(np.uint32)
        codes = codes[places].astype(self.code)
        upto = np.searchsorted(text_of[places], np.arange(n + 1))
        return [
            (
                int(count_a[t]), int(count_b[t]), int(n_groups[t]), int(n_links[t]), digests[t],
                codes[upto[t] : upto[t + 1]].tobytes(), times[upto[t] : upto[t + 1]].tobytes(),
            )
            for t in range(n)
        ]

    def _digests(self, ids_a, ids_b, ends_a, ends_b, both, tokens) -> list[str]:
        """SHA-256 of ``a,a|b;a|b,b`` per text."""
        group = np.cumsum(both)
        group_a, group_b = group[ends_a - 1], group[ends_b - 1]
        groups = int(group[-1]) if len(group) else 0
        upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=groups)), np.cumsum(np.bincount(group_b, minlength=groups))
        place_a = np.arange(len(ids_a)) + np.append(0, upto_b)[group_a]
        place_b = np.arange(len(ids_b)) + upto_a[group_b]
        ids, mark = np.zeros(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        mark[place_a[np.append(np.diff(group_a) > 0, True)[: len(ids_a)]]] = ord("|")
        mark[place_b[np.append(np.diff(group_b) > 0, True)[: len(ids_b)]]] = ord(";")
        raw, ends = self.numbers.joined(ids)
        raw[ends - 1] = mark
        raw, borders = raw.tobytes(), np.append(0, ends)[np.append(0, np.cumsum(tokens))].tolist()
        return [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(borders, borders[1:])]


def code_type(vocabulary_a: int, vocabulary_b: int):
    return np.uint32 if vocabulary_a * vocabulary_b <= 1 << 32 else np.uint64


def distinct_texts(documents: DataFrame) -> DataFrame:
    """key (SHA-256 of the text), text, copies; null and empty texts are left out."""
    rows = documents.select("text").filter("text IS NOT NULL AND text != ''")
    counted = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return counted.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "copies")


_ALIGNED = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def aligned(texts: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """One row per distinct text with its measures and its distinct pairs and how often it has each."""

    def run(batches):
        aligner = Aligner.of(tokenizer_a, tokenizer_b)
        for batch in batches:
            keys, copies = batch.column("key"), batch.column("copies")
            spaced = pc.binary_join_element_wise(pa.scalar(" "), batch.column("text"), pa.scalar(""))
            for i, j, data, offsets in text_slices(spaced, SLICE):
                numbers = list(zip(*aligner.align(data, offsets)))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [keys[i:j], copies[i:j], *[pa.array(x, k) for x, k in zip(numbers, kinds)]],
                    names=[f.split()[0] for f in _ALIGNED.split(", ")],
                )

    return texts.select("key", "copies", "text").mapInArrow(run, _ALIGNED)


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Numbers packed in a binary column, and how many each row has."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), np.diff(at) // np.dtype(kind).itemsize


def pair_counts(rows: DataFrame, scale: int, kind) -> DataFrame:
    """The corpus table of linked ids: code, a_id, b_id, count, best (a highest count of its B id).

    Tasks add up pairs of ``HELD`` and more entries before they shuffle. The window of a B id holds at most as many
    rows as A has ids.
    """

    def add(codes, weights):
        codes, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        sums = np.zeros(len(codes), np.int64)
        np.add.at(sums, inverse, np.concatenate(weights))
        return codes, sums

    def run(batches):
        codes, weights, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c, n = _flat(batch.column(1), kind)
            times, _ = _flat(batch.column(2), np.uint32)
            codes.append(c)
            weights.append(times * np.repeat(batch.column(0).to_numpy(), n))
            held += len(c)
            if held > 2 * HELD:
                c, w = add(codes, weights)
                if len(c) > HELD:
                    yield from _pairs(c, w)
                    c, w = c[:0], w[:0]
                codes, weights, held = [c], [w], len(c)
        if held:
            yield from _pairs(*add(codes, weights))

    def _pairs(codes, counts):
        for i in range(0, len(codes), 1 << 16):
            arrays = [pa.array(codes[i : i + (1 << 16)].astype(np.int64)), pa.array(counts[i : i + (1 << 16)])]
            yield pa.RecordBatch.from_arrays(arrays, names=["code", "count"])

    summed = rows.select("copies", "codes", "times").mapInArrow(run, "code long, count long").groupBy("code").agg(F.sum("count").alias("count"))
    b = F.pmod("code", F.lit(scale))
    ids = summed.select("code", F.floor(F.col("code") / scale).alias("a_id"), b.alias("b_id"), "count")
    return ids.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b_id")))


def _frequent(pairs: DataFrame, most: int) -> int:
    """The least count (a power of two) that at most ``most`` pairs reach."""
    bits = pairs.groupBy(F.length(F.bin("count")).alias("bits")).count().collect()  # at most 63 rows
    least, room = (1 << 63) - 1, most
    for row in sorted(bits, reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = 1 << (row["bits"] - 1)
    return least


def text_measures(rows: DataFrame, pairs: DataFrame, kind, scratch: Scratch, most: int = FREQUENT) -> DataFrame:
    """key, copies, the measures of ``rows``, n_best and count_sum."""
    session = rows.sparkSession
    least = _frequent(pairs, most)
    table = pairs.filter(F.col("count") >= least).orderBy("code").select("code", "count", "best").toArrow()
    codes, counts, best = (table.column(i).to_numpy() for i in range(3))
    shared = session.sparkContext.broadcast((codes.astype(kind), counts, best.astype(bool)))
    keep = ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    fields = _ALIGNED.rsplit(", ", 2)[0]

    def find(batch):
        known, counts, best = shared.value
        codes, n = _flat(batch.column("codes"), kind)
        times = _flat(batch.column("times"), np.uint32)[0].astype(np.int64)
        place = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
        hit = known[place] == codes if len(known) else np.zeros(len(codes), bool)
        return codes, times, n, place, hit, counts, best

    def measure(batches):
        for batch in batches:
            _, times, n, place, hit, counts, best = find(batch)
            if len(counts):
                weight, top = np.where(hit, counts[place], 0), hit & best[place]
            else:
                weight, top = np.zeros(len(times), np.int64), np.zeros(len(times), bool)
            at = np.append(0, np.cumsum(n))
            sums = [np.diff(np.append(0, np.cumsum(x))[at]) for x in (times * top, times * weight)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *[pa.array(x) for x in sums]], names=[*keep, "n_best", "count_sum"]
            )

    def rest(batches):
        for batch in batches:
            codes, times, n, _, hit, _, _ = find(batch)
            text = np.repeat(np.arange(batch.num_rows), n)[~hit]
            if len(text):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(text)), pa.array(codes[~hit].astype(np.int64)), pa.array(times[~hit])],
                    names=["key", "code", "times"],
                )

    found = rows.mapInArrow(measure, f"{fields}, n_best long, count_sum long")
    if pairs.filter(F.col("count") < least).isEmpty():
        return scratch.stored(found, "measures")
    rare = rows.mapInArrow(rest, "key binary, code long, times long").join(pairs.filter(F.col("count") < least), "code")
    more = rare.groupBy("key").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("__best"), F.sum(F.col("times") * F.col("count")).alias("__sum")
    )
    zero = F.lit(0).cast("long")
    both = found.join(more, "key", "left")
    return scratch.stored(
        both.select(
            *keep, (F.col("n_best") + F.coalesce("__best", zero)).alias("n_best"),
            (F.col("count_sum") + F.coalesce("__sum", zero)).alias("count_sum"),
        ),
        "measures",
    )


_MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def measured_documents(documents: DataFrame, tokenizer_a: str, tokenizer_b: str, most: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, measures and groups_sha256 per document; the pair table).

    Hot texts, with many copies, are looked up without moving their documents (see ``lookups``).
    """
    a, b = Encoder(tokenizer_a), PieceEncoder(tokenizer_b)
    kind = code_type(a.vocabulary, b.vocabulary)
    with Scratch(documents.sparkSession) as scratch:
        rows = scratch.stored(aligned(distinct_texts(documents), tokenizer_a, tokenizer_b), "aligned", 500)
        pairs = stored(pair_counts(rows, b.vocabulary, kind), "pairs", 2000)
        measures = text_measures(rows, pairs, kind, scratch, most)
        empty = F.col("text").isNull() | (F.col("text") == "")
        keyed = scratch.stored(documents.select("doc_id", F.when(~empty, F.unhex(F.sha2("text", 256))).alias("key")), "keys")
        with_text = looked_up(keyed.filter("key IS NOT NULL"), measures, ["key"], "copies")
        zero = F.lit(0).cast("long")
        without = keyed.filter("key IS NULL").select("doc_id", *[zero.alias(m) for m in _MEASURES], F.lit("").alias("groups_sha256"))
        columns = ["doc_id", *_MEASURES, "groups_sha256"]
        out = stored(with_text.select(*columns).unionByName(without.select(*columns)), "alignment")
    return out, pairs

"""Token-ID output: Arrow files of fixed-size-list batches.

``write_tokens`` range-partitions documents by their order, encodes them and writes one Arrow IPC file
per task. A file holds sequences of ``length`` token ids back to back over document borders, in columns

* ``ids``   fixed_size_list<uint16 or uint32>[length]
* ``valid`` fixed_size_list<bool>[length], false only in the padding of a file's last sequence
* ``ends``  fixed_size_list<bool>[length], true at the last id of a document

so sequence i of a memory-mapped file is found by arithmetic, without copying or decoding. A second
file lists the documents of the first in the same order (``doc_id``, ``n_tokens``). Both are written under a
temporary name and then renamed: a task that runs again replaces its files by equal ones.

Encoding: texts are cut where a token border must be (a single space, line feed or punctuation mark with
known neighbours; see ``cut_points``), equal pieces are encoded once, and results are put together by
position. Cuts only spare work: the ids are those of the whole text.

Added tokens (as ``<|endoftext|>``): with ``added_tokens`` the tokenizer stays at its defaults, so their strings in a text
become their ids, and no cut lies inside one. ``encode_corpus`` does so. Without it, the default of ``Encoder`` and
``write_tokens``, such strings are encoded as ordinary text (``encode_special_tokens`` of the library).

Null texts are empty and give the end id alone; repeated rows are documents of their own; an empty table
gives no files; other columns are ignored. Rows with equal order values stand next to each other in
arbitrary but fixed order; null order values come first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .kernels import BYTE_VALUES, release, span_hashes, text_slices
from .store import shared_folder, stored

#: Pieces a task remembers; the memory is emptied when full, which costs time only.
REMEMBERED = 1_000_000
#: Pieces given to the tokenizer in one call; its answers take far more room than the ids.
LEARNED_AT_ONCE = 4096
#: Bytes of text encoded at a time.
ENCODED_BYTES = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_PLAIN = np.zeros(256, bool)  # printable ASCII but space
_PLAIN[33:127] = True
#: First bytes of two-byte characters that are never white space (C2 starts U+0085 and U+00A0).
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions inside the bytes where byte-level pre-tokenisation always has a border.

    A lone space belongs to what follows it, a lone line feed to neither side, and a run of letters
    ends before a punctuation mark.
    """
    if len(data) < 3:
        return np.zeros(0, np.int64)
    plain = _PLAIN[data]
    lead = _LEAD[data]
    solid_before = plain.copy()  # the character that ends here is no white space
    solid_before[1:] |= lead[:-1] & (data[1:] >= 0x80)
    solid_from = plain | lead  # the character that starts here is no white space
    inner = slice(1, -1)
    lone = solid_before[:-2] & solid_from[2:]
    space = np.flatnonzero((data[inner] == 32) & lone) + 1
    feed = np.flatnonzero((data[inner] == 10) & lone) + 1
    mark = np.flatnonzero(_LETTER[data[:-1]] & _PUNCT[data[1:]]) + 1
    return np.concatenate([space, feed, feed + 1, mark])


class Encoder:
    """Encodes slices of texts; one per Python worker, tokenizer and way to take added tokens."""

    _made: dict[tuple[str, bool], Encoder] = {}

    @classmethod
    def of(cls, path: str, added_tokens: bool = False) -> Encoder:
        if (path, added_tokens) not in cls._made:
            cls._made[path, added_tokens] = cls(path, added_tokens)
        return cls._made[path, added_tokens]

    def __init__(self, path: str, added_tokens: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if not added_tokens:
            self.tokenizer.encode_special_tokens = True
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        if not added_tokens:
            added = [t for t in added if not t.special]
        changed = self.tokenizer.normalizer is not None and any(t.normalized for t in added)  # their strings are not those of the text
        self.uncut = changed or any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.added = [t.content.encode() for t in added]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of pieces
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """The cut points outside added tokens; none if what is around an added token counts."""
        if self.uncut:
            return np.zeros(0, np.int64)
        cuts, raw = cut_points(data), data.tobytes() if self.added else b""
        inside = None
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                inside = np.zeros(len(data), bool) if inside is None else inside
                inside[at + 1 : at + len(content)] = True
                at = raw.find(content, at + 1)
        return cuts if inside is None else cuts[~inside[cuts]]

    def _learn(self, hashes, data, starts, ends):
        raw, lists = data.tobytes(), []
        for k in range(0, len(starts), LEARNED_AT_ONCE):
            spans = zip(starts[k : k + LEARNED_AT_ONCE].tolist(), ends[k : k + LEARNED_AT_ONCE].tolist())
            found = self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8") for a, b in spans], add_special_tokens=False)
            lists += [np.array(e.ids, np.uint32) for e in found]
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate(lists) if lists else np.zeros(0, np.uint32)
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, flat])
        place = np.searchsorted(self.keys, hashes)
        self.keys, self.first, self.count = (
            np.insert(old, place, new) for old, new in ((self.keys, hashes), (self.first, first), (self.count, count))
        )

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        border = np.zeros(len(data) + 1, bool)
        border[self._cuts(data)] = True
        border[offsets] = True
        border[0] = border[-1] = True
        at = np.flatnonzero(border)
        starts, ends = at[:-1], at[1:]
        hashes = span_hashes(data, starts, ends, BYTE_VALUES)
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        near = place < len(self.keys)
        known[near] = self.keys[place[near]] == distinct[near]
        if not known.all():
            new = index[~known]
            self._learn(distinct[~known], data, starts[new], ends[new])
            place = np.searchsorted(self.keys, distinct)
        first, count = self.first[place][inverse], self.count[place][inverse]
        total = np.cumsum(count)
        gather = np.repeat(first - (total - count), count) + np.arange(total[-1])
        piece_of = np.searchsorted(starts, offsets)
        upto = np.concatenate([[0], total])[piece_of]
        return self.ids[gather], np.diff(upto)


class _Sequences:
    """Cuts a stream of ids into sequences and writes them."""

    def __init__(self, sink, schema: pa.Schema, length: int, rows: int):
        self.writer, self.schema, self.length, self.rows = pa.ipc.new_file(sink, schema), schema, length, rows
        self.ids, self.ends, self.held, self.written = [], [], 0, 0

    def add(self, ids: np.ndarray, ends: np.ndarray):
        self.ids.append(ids)
        self.ends.append(ends)
        self.held += len(ids)
        if self.held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool):
        ids, ends = np.concatenate(self.ids or [np.zeros(0, np.uint32)]), np.concatenate(self.ends or [np.zeros(0, bool)])
        full = len(ids) // self.length * self.length
        rest = len(ids) - full
        valid = np.ones(full, bool)
        if last and rest:
            pad = self.length - rest
            ids, ends = np.concatenate([ids, np.zeros(pad, ids.dtype)]), np.concatenate([ends, np.zeros(pad, bool)])
            valid = np.concatenate([np.ones(full + rest, bool), np.zeros(pad, bool)])
            full, rest = full + self.length, 0
        step = self.length * self.rows
        for a in range(0, full, step):  # all batches but the last hold ``rows`` sequences
            b = min(a + step, full)
            if not last and b - a < step:
                full = a
                break
            arrays = [
                pa.FixedSizeListArray.from_arrays(pa.array(x[a:b]).cast(f.type.value_type), type=f.type)
                for x, f in zip((ids, valid, ends), self.schema)
            ]
            self.writer.write_batch(pa.record_batch(arrays, schema=self.schema))
        self.ids, self.ends, self.held = [ids[full:]], [ends[full:]], len(ids) - full

    def close(self):
        self._flush(True)
        self.writer.close()


def sequence_schema(vocabulary: int, length: int) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema(
        [
            pa.field(name, pa.list_(pa.field("item", value, nullable=False), length), nullable=False)
            for name, value in (("ids", kind), ("valid", pa.bool_()), ("ends", pa.bool_()))
        ],
        metadata={"length": str(length)},
    )


_DOCS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def write_tokens(
    documents: DataFrame,
    tokenizer: str,
    folder: str,
    order: list[str | Column] | None = None,
    end_id: int = 2,
    length: int = 2048,
    rows: int = 64,
    added_tokens: bool = False,
) -> DataFrame:
    """Write token files to ``folder`` (a path or URI that all executors reach).

    Documents follow each other by rising values of ``order`` (default: ``doc_id``). Returns one row per file: part long,
    path string, docs long, tokens long.
    """
    keys = order or ["doc_id"]
    columns = ["doc_id", "text"]
    laid = documents.select(*columns, *[F.col(k).alias(f"__k{i}") if isinstance(k, str) else k.alias(f"__k{i}") for i, k in enumerate(keys)])
    names = [f"__k{i}" for i in range(len(keys))]
    laid = laid.repartitionByRange(*names).sortWithinPartitions(*names).select(*columns)

    def write(batches):
        release()
        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        encoder = out = None
        docs = tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = Encoder.of(tokenizer, added_tokens)
                fs, base = pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)
                fs.create_dir(base, recursive=True)
                final = [f"{base}/part-{part:06d}.{kind}.arrow" for kind in ("tokens", "docs")]
                draft = [f"{base}/.{attempt}-part-{part:06d}.{kind}" for kind in ("tokens", "docs")]
                sinks = [fs.open_output_stream(d) for d in draft]
                out = _Sequences(sinks[0], sequence_schema(encoder.vocabulary, length), length, rows)
                listing = pa.ipc.new_file(sinks[1], _DOCS)
            ids_of = batch.column(0)
            for i, j, data, offsets in text_slices(batch.column(1), ENCODED_BYTES):
                ids, counts = encoder.encode(data, offsets)
                borders = np.cumsum(counts)
                ids = np.insert(ids, borders, np.uint32(end_id))
                ends = np.zeros(len(ids), bool)
                counts += 1
                ends[np.cumsum(counts) - 1] = True
                out.add(ids, ends)
                listing.write_batch(pa.record_batch([ids_of[i:j].cast(pa.int64()), pa.array(counts)], schema=_DOCS))
                docs += j - i
                tokens += len(ids)
        if out is not None:
            out.close()
            listing.close()
            for sink, d, f in zip(sinks, draft, final):
                sink.close()
                fs.move(d, f)
            release()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:06d}"], "docs": [docs], "tokens": [tokens]})

    return stored(laid.mapInArrow(write, "part long, path string, docs long, tokens long"), "token-parts", 2000)


def open_file(path: str) -> pa.ipc.RecordBatchFileReader:
    """Memory-map a local file; other stores are read through their own file system."""
    fs, base = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
    source = pa.memory_map(base) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(base)
    return pa.ipc.open_file(source)


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Ids and valid mask of sequence ``i`` of a file written with ``rows`` sequences a batch; ids are a view."""
    batch = reader.get_batch(i // rows)
    length = batch.schema.field("ids").type.list_size
    k = i % rows * length
    ids = batch.column("ids").values.to_numpy()[k : k + length]
    return ids, batch.column("valid").values.slice(k, length).to_numpy(zero_copy_only=False)


def _documents_of(path: str):
    """(doc ids, token counts, id arrays) of a part, one batch of sequences at a time."""
    listing = open_file(f"{path}.docs.arrow").read_all()
    doc_ids, counts = listing.column(0), listing.column(1).to_numpy()
    tokens = open_file(f"{path}.tokens.arrow")
    done, held = 0, []
    for b in range(tokens.num_record_batches):
        batch = tokens.get_batch(b)
        valid = batch.column("valid").values.to_numpy(zero_copy_only=False)
        ids = batch.column("ids").values.to_numpy()[valid]
        ends = np.flatnonzero(batch.column("ends").values.to_numpy(zero_copy_only=False)[valid]) + 1
        pieces = np.split(ids, ends)
        for piece in pieces[:-1]:
            held.append(piece)
            whole = held[0] if len(held) == 1 else np.concatenate(held)
            if len(whole) != counts[done]:
                raise ValueError(f"{path}: document {done} has {len(whole)} ids, {counts[done]} listed")
            yield doc_ids[done].as_py(), whole
            done, held = done + 1, []
        if len(pieces[-1]):
            held.append(pieces[-1])
    if done != len(counts) or held:
        raise ValueError(f"{path}: {done} documents found, {len(counts)} listed")


def read_documents(parts: DataFrame) -> DataFrame:
    """Read token files back: doc_id long, start long (ids of all documents before), n_tokens long, ids_crc32 long."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = parts.select("part", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out, start = [], row["start"]
                for doc_id, ids in _documents_of(row["path"]):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    def _rows(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
        )

    spread = placed.repartition(max(parts.count(), 1))  # a task per file
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_corpus(documents: DataFrame, tokenizer: str, order: list[str | Column] | None = None, end_id: int = 2, length: int = 2048) -> DataFrame:
    """Write the token files of ``documents`` to a new shared folder and describe each document from them.

    Ids are those of the tokenizer at its defaults: the string of an added token becomes its id.
    """
    folder = shared_folder(documents.sparkSession, "tokens")
    return read_documents(write_tokens(documents, tokenizer, folder, order, end_id, length, added_tokens=True))

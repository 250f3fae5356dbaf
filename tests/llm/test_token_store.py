import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialweave.llm import token_store as ts
from trialweave.llm.kernels import text_slices

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(texts):
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_pieces_encode_like_whole_texts():
    random.seed(11)
    alphabet = list("ab' \n\t.,!s1é中ß<|>-A") + [" ", " ", "　", "\u0085", "'re", " don't", "  ", "\n\n", "\r\n", "<|endoftext|>", "É", "_", "\x00", "\x7f"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(20_000)]
    encoder, got = ts.Encoder(PATH), []
    for _, _, data, offsets in text_slices(pa.array(texts), 1 << 16):
        ids, counts = encoder.encode(data, offsets)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == whole(texts)


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"word{i} and more, {i * 7}" for i in range(3000)]
    encoder = ts.Encoder(PATH)
    monkeypatch.setattr(ts, "REMEMBERED", 50)
    got = []
    for _, _, data, offsets in text_slices(pa.array(texts), 2000):
        ids, counts = encoder.encode(data, offsets)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == whole(texts)


ROWS = [(5, "hello world", "x"), (2, None, "x"), (9, "", "x"), (3, "long " * 5000, "x"), (7, "same", "x"), (7, "same", "x"), (1, "<|endoftext|> # é", "x")]


def test_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string").repartition(3)
    parts = ts.write_tokens(docs, PATH, str(tmp_path), length=64, rows=4)
    out = sorted(tuple(r) for r in ts.read_documents(parts).collect())
    want, start = [], 0
    for (doc_id, text, _), ids in zip(sorted(ROWS, key=lambda r: r[0]), whole([r[1] for r in sorted(ROWS, key=lambda r: r[0])])):
        ids = np.array(ids + [2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert out == sorted(want)
    # sequences by arithmetic, without copies
    stream = []
    for row in sorted(parts.collect(), key=lambda r: r.part):
        reader = ts.open_file(f"{row.path}.tokens.arrow")
        n = sum(reader.get_batch(i).num_rows for i in range(reader.num_record_batches))
        assert n == -(-row.tokens // 64)
        for i in range(n):
            ids, valid = ts.sequence(reader, i, rows=4)
            assert len(ids) == len(valid) == 64 and not ids.flags.owndata
            assert valid.all() or i == n - 1
            stream += ids[valid].tolist()
    assert len(stream) == start


def test_other_orders_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    out = ts.encode_corpus(docs, PATH, [-F.col("doc_id")], length=32).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((r[0] for r in ROWS), reverse=True)
    assert ts.encode_corpus(docs.limit(0), PATH).count() == 0


def test_corpus_ids_are_those_of_the_unmodified_tokenizer(spark):
    texts = ["end<|endoftext|>start", "a <|endoftext|> b, c", "<|endoftext|><|endoftext|>'s", "x\n<|endoftext|>\ny", "<|endoftext <|endoftext|", "no such string", None]
    unmodified = tokenizers.Tokenizer.from_file(PATH)
    random.seed(12)
    parts = ["<|endoftext|>", "<|end", "oftext|>", "|>", "<", " ", "\n", "word", "'s", ",", "é", "  ", "A"]
    texts += ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ts.encode_corpus(docs, PATH).collect()}
    want, start = {}, 0
    for i, text in enumerate(texts):
        ids = np.array(unmodified.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert want[0][1] == 4
    assert got == want

import hashlib
import random
from collections import Counter

import pytest

from trialweave.llm import align
from trialweave.llm.queries import tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


def plain_tokens(text):
    """(id, bytes) lists of whole texts by the libraries alone."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(plain_tokens, "a"):
        plain_tokens.a, plain_tokens.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        plain_tokens.a.encode_special_tokens = True
        keep = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
        plain_tokens.byte = {}
        for x in range(256):
            plain_tokens.byte[chr(x) if x in keep else chr(256 + len([y for y in range(x) if y not in keep]))] = x
    a = [(i, bytes(plain_tokens.byte[c] for c in plain_tokens.a.id_to_token(i))) for i in plain_tokens.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in plain_tokens.b.encode(text):
        piece = plain_tokens.b.id_to_piece(i)
        b.append((i, bytes.fromhex(piece[3:5]) if plain_tokens.b.is_byte(i) else piece.replace("▁", " ").encode()))
    return a, b


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def expected(documents):
    counts, per_text = Counter(), {}
    for _, text in documents:
        if text and text not in per_text:
            a, b = plain_tokens(text)
            raw = (" " + text).encode()
            if b"".join(r for _, r in a) != raw or b"".join(r for _, r in b) != raw:
                per_text[text] = None
                continue
            a, b = spans(a), spans(b)
            links = [(x, y) for x, i, j in a for y, k, m in b if max(i, k) < min(j, m)]
            ends = sorted({j for _, _, j in a} & {m for _, _, m in b})
            groups = [
                ",".join(str(x) for x, _, j in a if low < j <= high) + "|" + ",".join(str(y) for y, _, m in b if low < m <= high)
                for low, high in zip([0, *ends], ends)
            ]
            per_text[text] = len(a), len(b), groups, links
        if text and per_text[text]:
            counts.update(per_text[text][3])
    high = Counter()
    for (_, y), n in counts.items():
        high[y] = max(high[y], n)
    rows = []
    for doc_id, text in documents:
        made = per_text.get(text) if text else None
        if made is None:
            rows.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = made
        best = sum(counts[p] == high[p[1]] for p in links)
        rows.append((doc_id, a, b, len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(rows, key=str), counts


DOCUMENTS = [
    (1, "The quick brown fox, jumps  over\n\nthe lazy dog!!"), (2, None), (3, ""), (4, " "), (5, "The quick brown fox, jumps  over\n\nthe lazy dog!!"),
    (5, "again the same id"), (6, "a▁b keeps no bytes"), (7, "日本語 text 😀 and <|endoftext|> </s> <0x41> <unk>"), (8, "tab\tand\r\nnul\x00 end "),
    (9, "   leading"), (10, "x" * 3000), (11, "naïve café ﬁ  ​ ç"), (None, "no id"), (12, "a"), (12, "a"), (13, "▁"), (14, "word " * 400),
]


def check(spark, documents, most):
    frame = spark.createDataFrame([(*d, 9, b"x") for d in documents], "doc_id long, text string, copies int, key binary").repartition(3)
    out, pairs = align.measured_documents(frame, A, B, most)
    rows, counts = expected(documents)
    assert sorted((tuple(r) for r in out.collect()), key=str) == rows
    got = {(r.a_id, r.b_id): r["count"] for r in pairs.collect()}
    assert got == counts


@pytest.mark.parametrize("most", [align.FREQUENT, 8, 0])
def test_against_brute_force(spark, most):
    """The same result whether all, some or no pairs are broadcast."""
    check(spark, DOCUMENTS, most)


def test_random_texts(spark, monkeypatch):
    monkeypatch.setattr(align, "SLICE", 200)
    rng = random.Random(8)
    parts = ["the", " ", "  ", "\n", "é", "Ж", "'s", "'", ",", "\t", "12", "3", "_", "ing", "▁", "猫", "<0x0A>", "́", "A", " ?", " "]
    documents = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))) for i in range(250)]
    check(spark, documents, 50)


def test_texts_of_the_tables(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in rows if r.text is None or len(r.text) < 1500], 1000)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    out, pairs = align.measured_documents(frame, A, B)
    assert out.count() == 0 and pairs.count() == 0

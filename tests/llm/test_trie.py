import hashlib
import random
import zlib

import pytest

from trialweave.llm import queries, trie
from trialweave.llm.store import Scratch


def expected(rows):
    """The contract by plain recursion; rows are (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))

    def order(t):
        turn, role, text = t
        return (turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())

    convs = {c: [(r, x) for _, r, x in sorted(ts, key=order)] for c, ts in convs.items()}
    new = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = convs.get(c - c % 20, [])[:h] + ts[h:]
    members = {}
    for c, ts in new.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def words(text):
        return len([w for w in text.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])

    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[b] for b in below) if below else 1
        saved[k] = (len(members[k]) - 1) * (words(k[-1][1]) if k else 0) + sum(saved[b] for b in below)
    return {
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if new[c] == list(k)).encode()).hexdigest())
        for k, m in members.items()
    }


def result(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    numbered, conversations = queries.rebuilt_turns(spark, trie.turns(frame))
    return [tuple(r) for r in trie.trie(numbered, conversations).collect()]


def test_against_recursion(spark):
    rng = random.Random(4)
    rows = [
        (c, t, rng.choice(["user", "bot"]), " ".join(rng.choice(["a", "b"]) for _ in range(rng.randint(0, 3))))
        for c in range(90) if c != 40
        for t in range(rng.randint(1, 7))
    ]
    rows += [(c, t, "user", "same again") for c in range(100, 160) for t in range(3)]  # a group of copies
    rows += [(201, t, "user", f"deep {t}") for t in range(90)]  # a long chain
    # null turns, roles, texts and ids; repeated rows; ties; a conversation whose base is absent and which loses all turns
    rows += [(61, None, None, None), (61, None, "x", "first"), (62, 1, "u", "tie"), (62, 1, "u", "also"), (62, 1, "u", "tie")]
    rows += [(None, 1, "u", "lost"), (341, 0, "u", "\x00\x0b odd\x85space"), (351, 0, "u", ""), (352, 0, "u", "")]
    got = result(spark, rows)
    assert len(got) == len(set(got)) and set(got) == expected(rows)


def test_empty(spark):
    assert result(spark, []) == []


def test_run_borders_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 4)
    rows = [(c, t, "u", f"t{t if t < 13 else c}") for c in (1, 2, 5) for t in range(20)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, pos int")
    numbered, conversations = queries.rebuilt_turns(spark, trie.turns(frame))
    assert {tuple(r) for r in trie.trie(numbered, conversations).collect()} == expected(rows)


@pytest.mark.parametrize("shape", ["chain", "comb", "random"])
def test_contraction(spark, shape):
    """Totals of any tree; rounds grow with the logarithm of a chain's length."""
    rng, n = random.Random(1), 300
    up = {0: None}
    for v in range(1, n):
        up[v] = v - 1 if shape == "chain" else (rng.randrange(v) if shape == "random" else (v - 1 if v % 2 else max(v - 2, 0)))
    depth = {0: 0}
    for v in range(1, n):
        depth[v] = depth[up[v]] + 1
    sums = {v: v + 1 for v in up}
    for v in range(n - 1, 0, -1):
        sums[up[v]] += sums[v]
    tree = spark.createDataFrame([(v, depth[v], up[v], v + 1) for v in up], "conv_id long, depth long, parent_conv_id long, w long")
    with Scratch(spark) as scratch:
        made = []
        scratch.stored, plain = (lambda df, name, **k: made.append(name) or plain(df, name, **k)), scratch.stored
        got = {r.conv_id: r.total for r in trie.subtree_totals(tree, {"total": "w"}, scratch).collect()}
    assert got == sums
    assert made.count("round") <= 14

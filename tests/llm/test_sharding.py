import hashlib
from collections import defaultdict

from trialweave.llm import sharding


def plain(rows, limit):
    """Split buckets bit by bit."""
    bits = {i: f"{int(hashlib.md5(('' if d is None else str(d)).encode()).hexdigest()[:15], 16):060b}" for i, (d, _) in enumerate(rows)}
    size = {i: len((t or "").encode()) for i, (_, t) in enumerate(rows)}
    out, open_ = {}, [("", list(bits))]
    while open_:
        prefix, inside = open_.pop()
        if sum(size[i] for i in inside) <= limit or len(prefix) == 60:
            out.update({i: prefix for i in inside})
            continue
        for bit in "01":
            if part := [i for i in inside if bits[i].startswith(prefix + bit)]:
                open_.append((prefix + bit, part))
    return out, size


def run(spark, rows, limit, **more):
    docs = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "n int, doc_id long, text string")
    return sharding.shard(docs, limit, **more).collect()


def test_matches_bit_by_bit_splits(spark):
    rows = [(i, "é" * (i * 7 % 90)) for i in range(400)] + [(None, "abc"), (1000, None), (1001, "x" * 900)]
    for limit, step in ((700, 2), (700, 10), (10**9, 10)):
        want, _ = plain(rows, limit)
        got = run(spark, rows, limit, step=step)
        big = {r.n for r in got if r.oversized}
        assert {r.n: r.shard for r in got if r.n not in big} == {i: p for i, p in want.items() if i not in big}
        total = defaultdict(int)
        for r in got:
            total[r.shard, r.page] += r.bytes
        assert all(v <= limit or any(r.oversized and (r.shard, r.page) == k for r in got) for k, v in total.items())


def test_one_key_above_the_limit_goes_to_pages(spark):
    rows = [(7, "a" * (50 + i % 30)) for i in range(100)] + [(7, "same text of one key")] * 40 + [(i, "b" * 100) for i in range(100, 140)]
    got = run(spark, rows, 500)
    assert sorted(r.n for r in got) == list(range(len(rows)))
    total = defaultdict(int)
    for r in got:
        total[r.shard, r.page] += r.bytes
    assert max(total.values()) <= 500
    assert not any(r.oversized for r in got)


def test_empty_table_and_clashing_names(spark):
    assert run(spark, [], 100) == []
    docs = spark.createDataFrame([(1, "abc", "mine")], "doc_id long, text string, shard string")
    row = sharding.shard(docs, 100).first()
    assert (row["shard"], row["depth"], row["bytes"]) == ("", 0, 3)

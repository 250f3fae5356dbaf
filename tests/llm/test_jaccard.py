import random
import re
from collections import defaultdict

import numpy as np
import pytest

from trialweave.llm import jaccard
from trialweave.llm.components import components


def sets_of(docs):
    out = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    return out


def plain(docs):
    sets = sets_of(docs)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def joined(spark, docs):
    rows = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def edited(words, n):
    words = list(words)
    for _ in range(n):
        k = random.randrange(len(words))
        kind = random.random()
        if kind < 0.6:
            words[k] = f"e{random.randrange(10**6)}"
        elif kind < 0.8:
            words.insert(k, f"e{random.randrange(10**6)}")
        elif len(words) > 1:
            del words[k]
    return words


def corpus(seed, groups=40, copies=6):
    random.seed(seed)
    texts = []
    for _ in range(groups):
        n = random.choice([1, 2, 3, 4, 5, 8, 9, 10, 12, 14, 15, 16, 17, 20, 25, 40, 80, 200, 400])
        base = [f"w{random.randrange(3000)}" for _ in range(n)]
        texts.append(base)
        for _ in range(random.randrange(copies)):
            texts.append(edited(random.choice(texts[-3:]), random.choice([0, 1, 1, 2, n // 40, n // 30, n // 25])))
    random.shuffle(texts)
    return [(i * 3, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    docs = corpus(seed) + [(10_001, None), (10_002, ""), (10_003, " \t "), (10_004, "One"), (10_005, "one")]
    assert joined(spark, docs) == plain(docs)


def test_large_group_around_a_hub(spark):
    # copies that link with the first text but mostly not with each other
    random.seed(5)
    base = [f"w{i}" for i in range(200)]
    docs = [(0, " ".join(base))] + [(i, " ".join(edited(base, 5))) for i in range(1, 60)]
    assert joined(spark, docs) == plain(docs)


def test_buckets_in_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    random.seed(6)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(edited(base, i % 5))) for i in range(40)] + [(i + 100, t) for i, t in corpus(3, groups=10)]
    assert joined(spark, docs) == plain(docs)


def test_copies_in_opposite_order_in_several_partitions(spark):
    # every key of a pair is given out by both partitions, for both texts
    random.seed(7)
    pairs = []
    for _ in range(12):
        base = [f"w{random.randrange(10**6)}" for _ in range(120)]
        pairs.append((" ".join(base), " ".join(edited(base, 2))))
    first = [t for x, y in pairs for t in (x, y)]
    second = [t for x, y in pairs for t in (y, x)]
    docs = list(enumerate(first + second))
    table = spark.createDataFrame(spark.sparkContext.parallelize(docs, 2), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(table).collect()}
    assert got == plain(docs)
    members = jaccard.shared_keys(jaccard.key_rows(table, jaccard.keyed_sets))
    assert members.count() == members.distinct().count()


def test_far_blocks_of_a_bucket_meet_without_a_refuted_pair(spark, monkeypatch):
    def one_key(column):
        for tokens in jaccard.shingle_sets(column):
            yield jaccard.set_id(tokens), lambda: np.array([1 << 40], np.uint64)

    monkeypatch.setattr(jaccard, "keyed_sets", one_key)
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    random.seed(9)
    docs = []
    for i in range(20):
        base = [f"w{random.randrange(10**6)}" for _ in range(100)]
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + ["more"]))]
    assert joined(spark, docs) == plain(docs)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(6, 120))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        most = jaccard.most_different(2 * n)
        drop = int(rng.integers(0, most + 1))
        add = int(rng.integers(0, most - drop + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and len(a) != both:
            assert np.intersect1d(jaccard.keys(a), jaccard.keys(b)).size, (len(a), len(b), both)


def test_bands_hold_every_pair_that_can_link():
    for small in range(jaccard.SMALL, 3000):
        for large in {small, jaccard.largest_partner(small)}:
            assert set(jaccard.bands_of(small)) & set(jaccard.bands_of(large)), (small, large)
    for number in range(20):
        low, high, segments, spare = jaccard.band(number)
        assert segments - spare >= jaccard.most_different(2 * high)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for _ in range(500):
        a = rng.integers(0, 2**64, int(rng.integers(1, 300)), dtype=np.uint64)
        b = np.concatenate([a[int(rng.integers(0, len(a))) :], rng.integers(0, 2**64, int(rng.integers(0, 50)), dtype=np.uint64)])
        x, y = jaccard.sketch(np.unique(a)), jaccard.sketch(np.unique(b))
        n = min(len(x), len(y))
        apart = int(np.bitwise_count(jaccard.folded(x, n) ^ jaccard.folded(y, n)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(5, text, 1), (5, text, 2), (3, text, 1), (None, text, 1)], "doc_id long, text string, n_shingles int")
    rows = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()))
    assert rows == [(-1, 5, 3), (3, 5, 3), (5, 5, 3), (5, 5, 3)]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for node in sorted(near):
        if node not in want:
            open_ = [node]
            while open_:
                x = open_.pop()
                if x not in want:
                    want[x] = node
                    open_ += near[x]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want

import random

import numpy as np

from trialweave.llm import passages


def plain_windows(values, least):
    """All (l, c, r) by definition: the widest range around c in which values[c] is the least."""
    out = []
    for c in range(len(values)):
        low = c
        while low and values[low - 1] > values[c]:
            low -= 1
        high = c
        while high + 1 < len(values) and values[high + 1] > values[c]:
            high += 1
        if high - low + 1 >= least:
            out.append((low, c, high))
    return sorted(out)


def test_compact_windows_are_the_wide_nodes_of_the_tree():
    rng = np.random.default_rng(1)
    for _ in range(200):
        values = rng.permutation(int(rng.integers(1, 150))).astype(np.uint64)
        for least in (1, 5, 46):
            assert sorted(map(tuple, passages.compact_windows(values, least=least).tolist())) == plain_windows(values, least)


def test_trees_are_grown_over_the_places_that_can_be_least():
    rng = np.random.default_rng(2)
    for top in (2, 9, 2**60):  # with and without ties
        borders = np.append(0, np.cumsum(rng.integers(0, 120, 12)))
        values = rng.integers(1, top, borders[-1]).astype(np.uint64)
        runs = [range(i, i + 46) for a, b in zip(borders[:-1], borders[1:]) for i in range(a, b - 45)]
        expected = {k for run in runs for k in run if values[k] == min(values[j] for j in run)}
        assert passages._least_places(values, borders, 46).tolist() == sorted(expected)
    values = rng.integers(1, 2**60, 20_000).astype(np.uint64)
    places = passages._least_places(values, np.array([0, len(values)]), 46)
    assert len(places) < len(values) // 20
    assert set(passages.compact_windows(values)[:, 1]) == set(places)


def test_trees_of_many_texts_grow_like_single_ones():
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 60, int(n)).astype(np.uint64) for n in rng.integers(1, 300, 60)]  # with ties
    borders = np.append(0, np.cumsum([len(t) for t in texts]))
    together = passages.compact_windows(np.concatenate(texts), borders)
    alone = [passages.compact_windows(t) + b for t, b in zip(texts, borders)]
    assert sorted(map(tuple, together.tolist())) == sorted(tuple(x) for t in alone for x in t.tolist())
    for table, text in zip(passages.window_tables(np.concatenate(texts), borders), texts):
        assert np.sort(table).tobytes() == np.sort(passages.window_table(text)).tobytes()


def test_keys_of_many_texts_are_those_of_single_ones():
    import pyarrow as pa

    docs, _ = corpus(n=40)
    texts = [None, "", "few words", *(t for _, t in docs), "same " * 80]
    found = dict((own, made()) for own, made in passages.keyed_texts(pa.array(texts)))
    for _, own, tokens in passages.shingle_rows(pa.array(texts)):
        if len(tokens) >= passages.SPAN:
            assert np.array_equal(found.pop(own), np.unique(passages.occurrences(passages.window_table(tokens))[0]))
    assert not found


def test_recall_against_all_pairs_of_windows(spark):
    """Every 50-word window with a window of another text at similarity 0.8 or more, by brute force over all pairs."""
    rng = random.Random(12)
    passage = [[f"p{i}_{k}" for k in range(60)] for i in range(6)]
    texts = []
    for i in range(60):
        own = list(rng.choice(passage))
        for _ in range(rng.randint(0, 1)):
            own[rng.randrange(len(own))] = f"edit{i}"
        head, tail = ([f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40))] for _ in range(2))
        texts.append([*head, *own, *tail])
    windows = [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 49)]
    number = {}
    flags = np.zeros((len(windows), 20_000), np.float32)
    for row, (i, s) in enumerate(windows):
        for k in range(s, s + 46):
            flags[row, number.setdefault(tuple(texts[i][k : k + 5]), len(number))] = 1
    common = flags @ flags.T
    text = np.array([i for i, _ in windows])
    near = (common >= 0.8 * (92 - common)) & (text[:, None] != text)
    wanted = [w for w, hit in zip(windows, near.any(axis=1)) if hit]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = {}
    for r in passages.repeated_passages(frame).collect():
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    caught = sum(any(a <= s and s + 50 <= b for a, b in spans.get(i, [])) for i, s in wanted)
    assert len(wanted) > 500 and caught / len(wanted) > 0.97


def test_every_passage_lies_in_one_window_per_function():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 40, 200).astype(np.uint64)  # with ties
    windows = passages.compact_windows(values, least=46).tolist()
    for s in range(200):
        for e in range(s + 45, 200):
            assert sum(low <= s <= c <= e <= high for low, c, high in windows) == 1


def corpus(seed=3, n=120):
    random.seed(seed)

    def say(k):
        return [f"w{random.randrange(50_000)}" for _ in range(k)]

    passage = [say(70), say(120), say(55)]
    docs, planted = [], {}
    for i in range(n):
        text = say(random.randint(60, 300))
        if i % 3 == 0:
            own = list(random.choice(passage))
            if i % 2:
                own[len(own) // 2] = "changed"
            at = random.randrange(len(text))
            planted[i] = (at, at + len(own))
            text[at:at] = own
        docs.append((i, " ".join(text).upper() if i % 5 == 0 else " ".join(text)))
    return docs, planted


def found(spark, docs):
    out = {}
    for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        out.setdefault(r.doc_id, []).append((r.start_word, r.end_word, r.partner_doc_id))
    return out


def test_planted_passages_are_found_and_nothing_else(spark):
    docs, planted = corpus()
    got = found(spark, docs)
    assert set(got) == set(planted)
    for i, (a, b) in planted.items():
        (start, end, partner), = got[i]
        assert partner in planted and partner != i
        assert a - 9 <= start <= a + 9 and b - 9 <= end <= b + 9, (i, a, b, start, end)


def hot_passages(seed=8, texts=12):
    """Edited versions of one passage, each near to the unedited one alone."""
    random.seed(seed)
    docs = []
    for p in range(6):
        base = [f"p{p}x{k}" for k in range(52)]
        for i in range(texts):
            own = list(base)
            if i:
                own[8 + 3 * i % 36] = f"edit{p}x{i}"
            side = [f"s{random.randrange(10**7)}" for _ in range(60)]
            docs.append((len(docs), " ".join(side[:30] + own + side[30:])))
    return docs


def near_texts(docs):
    """Ids of the texts with a verified candidate passage, from all pairs."""
    rows = {i: next(passages.shingle_rows(passages.pa.array([t])))[2] for i, t in docs}
    tables = {i: passages.window_table(t) for i, t in rows.items()}
    short = {i: (t & np.uint64(0xFFFF)).astype("<u2") for i, t in rows.items()}
    return {i for i in rows for j in rows if i != j and passages.common_passages(short[i], short[j], tables[i], tables[j])}


def test_edited_versions_around_one_unedited_passage(spark, monkeypatch):
    docs = hot_passages()
    want = near_texts(docs)
    assert len(want) > 40
    got = found(spark, docs)
    assert set(got) >= want
    for i, spans in got.items():
        for start, end, _ in spans:
            assert 20 <= start and end <= 92, (i, start, end)
    monkeypatch.setattr(passages, "BLOCK", 3)
    assert set(found(spark, docs)) == set(got)


def test_every_passage_has_a_key_for_two_functions():
    rng = np.random.default_rng(4)
    for _ in range(50):
        tokens = rng.integers(0, 2**63, int(rng.integers(46, 300))).astype(np.uint64)
        _, first, last, c = passages.occurrences(passages.window_table(tokens))
        for s in range(len(tokens) - 45):
            inside = (first <= s) & (s <= last)
            assert inside.sum() == 6 and ((s <= c[inside]) & (c[inside] <= s + 45)).all()


def test_copies_short_texts_and_edge_rows(spark):
    text = " ".join(f"x{i}" for i in range(60))
    docs = [(1, text), (2, text), (2, text), (3, text.upper()), (4, " ".join(text.split()[:49])), (5, None), (6, ""), (None, text),
            (7, "ha " * 5000), (8, "ho " * 400 + "ha " * 70), (9, " ".join(f"y{i}" for i in range(80)))]
    got = found(spark, docs)
    assert {i: v for i, v in got.items() if i < 7} == {1: [(0, 60, 3)], 2: [(0, 60, 1)], 3: [(0, 60, 1)]}
    assert 9 not in got
    assert found(spark, []) == {}


def plain_common(a, b, windows_a, windows_b):
    """Verified passages of two texts, vote by vote and passage by passage."""
    votes = []
    for x in windows_a.tolist():
        for y in windows_b.tolist():
            d = y[1] - x[1]
            first, last = max(x[2], y[2] - d), min(x[3], y[3] - d)
            if x[0] == y[0] and first <= last:
                votes.append((d, first, last, x[0] & 3))
    votes.sort()
    cuts = [0, *(i for i in range(1, len(votes)) if votes[i][0] - votes[i - 1][0] > passages.SLACK), len(votes)]
    out = []
    for group in (votes[i:j] for i, j in zip(cuts[:-1], cuts[1:]) if i < j):
        middle, places = group[len(group) // 2][0], []
        for s in range(min(v[1] for v in group), max(v[2] for v in group) + 1):
            near = [
                sum(any(0 <= k + d + e < len(b) and a[k] == b[k + d + e] for e in range(-2, 3)) for k in range(s, s + passages.SPAN))
                for d in {v[0] for v in group}
            ]
            if len({f for _, i, j, f in group if i <= s <= j}) >= passages.ENOUGH and max(near) >= passages.MATCHING:
                places.append(s)
        while places:
            n = next((k for k in range(1, len(places)) if places[k] != places[0] + k), len(places))
            s, e = places[0], places[n - 1] + passages.WORDS
            out.append((s, e, max(0, s + middle), min(len(b) + passages.SHINGLE - 1, e + middle)))
            places = places[n:]
    return out


def test_pairs_compared_together_give_what_each_gives_alone(monkeypatch):
    rng = np.random.default_rng(11)
    texts = []
    for k in range(14):  # copies of a text with edits, insertions and repeated lines
        own = rng.integers(0, 2**63, 230) if k % 7 == 0 else own.copy()
        own[rng.integers(0, len(own), 4)] = rng.integers(0, 2**63, 4)
        if k % 3 == 1:
            own = np.insert(own, int(rng.integers(0, len(own))), rng.integers(0, 2**63, 1 + k % 2))
        texts.append(np.concatenate([own[:60], own[:55], own[60:]]) if k % 4 == 2 else own)
    rows = [((t & 0xFFFF).astype("<u2"), passages.window_table(t.astype(np.uint64))) for t in texts]
    pairs = [(a, b, x, y) for a, x in rows[::2] for b, y in rows]
    want = [plain_common(*p) for p in pairs]
    assert sum(len(x) > 1 for x in want) > 10 and not all(want)
    assert passages.passages_of_pairs(pairs) == want
    assert [passages.common_passages(*p) for p in pairs] == want
    for name, value in (("PLACES", 50), ("WINDOWS", 20)):
        monkeypatch.setattr(passages, name, value)
        assert passages.passages_of_pairs(pairs) == want


def test_open_occurrences_are_compared_many_at_once(monkeypatch):
    rng = np.random.default_rng(12)
    base, size, rows = rng.integers(0, 2**16, 95), passages.SPAN, []
    for k in range(40):
        own = base.copy()
        own[rng.integers(0, 95, 7)] = rng.integers(0, 2**16, 7)
        first = int(rng.integers(-45, 1))
        rows.append((k // 2, k % 2, k % 3 > 0, 300 + first, 300 + int(rng.integers(first, 1)), 300, own.astype("<u2").tobytes()))

    def plain(rows):
        out, two = set(), len({r[1] for r in rows}) > 1
        words = [np.frombuffer(r[6], "<u2").tolist() for r in rows]
        for mine, r in zip(words, rows):
            for s in range(r[3], r[4] + 1) if r[2] else ():
                i = s - r[5] + passages._REACH
                for theirs, o in zip(words, rows):
                    same = sum(mine[k] in theirs[k - 2 : k + 3] for k in range(i, i + size))
                    if o[0] != r[0] and (o[1] != r[1] or not two) and same >= passages.MATCHING:
                        out.add((r[0], r[3], s, o[0]))
        return out

    for some in (rows, rows[::2]):
        want = plain(some)
        covered = {(own, s) for own, _, s, _ in want}
        for pairs in (1, 100, passages.PAIRS):
            monkeypatch.setattr(passages, "PAIRS", pairs)
            got = passages.uncovered_spans(some)
            assert {(own, s) for own, a, b, _ in got for s in range(a, b - passages.WORDS + 1)} == covered
            assert all(any((own, p) == (w[0], w[3]) for w in want) for own, _, _, p in got)
        assert covered

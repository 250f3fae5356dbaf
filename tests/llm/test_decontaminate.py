import random
import re

from trialweave.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        if w and name is not None:
            m = min(13, len(w))
            for s in range(len(w) - m + 1):
                windows.setdefault(tuple(w[s : s + m]), set()).add(str(name))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                names = windows.get(tuple(w[s : s + m]))
                if names:
                    hit |= set(range(s, s + m))
                    found |= names
        out.append((doc_id, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def judged(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.score(d, b, ["doc_id"], **more).select("doc_id", "n_words", dc.n_hit().alias("h"), "items", dc.contaminated().alias("c")).collect()
    return sorted(((r.doc_id, r.n_words, r.h, ",".join(r["items"]), r.c) for r in rows), key=str)


def cases():
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "x1", "日本"]

    def say(n):
        return " ".join(random.choice(vocabulary) for _ in range(n))

    items = [(i, say(random.choice([1, 3, 12, 13, 14, 30, 60]))) for i in range(25)] + [(100, None), (101, "?!"), (None, "w1 w2"), (7, say(20))]
    docs = []
    for i in range(60):
        planted = random.choice([x for _, x in items if x])
        docs.append((i, say(random.randint(0, 60)) + ". " + planted.upper() + "! " + say(random.randint(0, 200))))
    return docs + [(60, None), (61, ""), (62, "w1"), (62, "w1"), (None, items[3][1]), (63, items[5][1] * 400)], items


def test_matches_plain_version(spark):
    docs, items = cases()
    assert judged(spark, docs, items) == plain(docs, items)


def test_blocks_of_the_benchmark_give_the_same(spark):
    docs, items = cases()
    assert judged(spark, docs, items, block_bytes=2000) == plain(docs, items)


def test_empty_sides_and_clashing_names(spark):
    docs, items = cases()
    assert judged(spark, docs[:5], []) == plain(docs[:5], [])
    assert judged(spark, [], items) == []
    d = spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, items string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    row = dc.score(d, b).first()
    assert row["items"] == ["1"] and row["text"] == "a b"


def test_winnowing_keeps_the_least_of_each_window():
    import numpy as np

    x = np.array([5, 3, 9, 1, 7, 2, 8], np.uint64)
    for size in range(1, 8):
        assert dc.winnow(x, size).tolist() == [min(x[i : i + size]) for i in range(len(x) - size + 1)]

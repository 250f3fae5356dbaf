import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trialweave.llm import quality as q


def area(high, low):
    return np.mean([(a > b) + 0.5 * (a == b) for a in high for b in low])


def test_features_of_a_text():
    texts = ["Ab cd cd. X", "one one\none one\ntwo", None, "", "ÄÉ | $$ 12", "!"]
    x = dict(zip(q.FEATURES, q.measure(pa.array(texts)).T))
    assert np.allclose(x["log_words"], np.log1p([4, 5, 0, 0, 4, 1]))
    assert np.allclose(x["distinct_words"], [1, 2 / 5, 0, 0, 1, 1])  # "cd" and "cd." differ
    assert np.allclose(x["commonest_word"][:2], [1 / 4, 4 / 5]) and np.allclose(x["same_as_before"][:2], [0, 3 / 5])
    assert np.allclose(x["word_length"], [8 / 4, 3, 0, 0, 7 / 4, 1])
    assert np.allclose(x["repeated_lines"], [0, 1 / 3, 1, 1, 0, 0])
    assert x["bars"][4] == 1 / 10 and x["mark_runs"][4] == 1 / 10 and x["lone_letters"][0] == 1 / 4
    assert all(np.isfinite(c).all() for c in x.values())


def test_features_do_not_depend_on_neighbours():
    texts = ["a b", "b b!", "", "!c", "b\nb\n", "x" * 300_000, "né " * 100_000, "|"]
    together = q.measure(pa.array(texts))
    alone = np.concatenate([q.measure(pa.array([t])) for t in texts])
    assert np.allclose(together, alone)


def test_shallow_tree_is_the_best_of_its_cuts():
    rng = np.random.default_rng(3)
    g, h = rng.normal(size=12), rng.uniform(0.5, 1, 12)
    values = q.shallow_tree(g, h, 2)

    def gain(cut):
        return sum(x.sum() ** 2 / (y.sum() + 1) for x, y in ((g[:cut], h[:cut]), (g[cut:], h[cut:])))

    cut = max(range(1, 12), key=gain)
    assert np.allclose(values[:cut], g[:cut].sum() / (h[:cut].sum() + 1)) and np.allclose(values[cut:], g[cut:].sum() / (h[cut:].sum() + 1))
    assert len(set(q.shallow_tree(g, h, 3))) == 3 and len(q.shallow_tree(g[:1], h[:1], 3)) == 1


def test_quadrants_against_all_splits():
    rng = np.random.default_rng(5)
    g, h = rng.normal(size=(5, 7)), rng.uniform(0.5, 1, (5, 7))

    def gain(i, j):
        parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 7)), (slice(i, 5), slice(0, j)), (slice(i, 5), slice(j, 7))]
        return sum(g[p].sum() ** 2 / (h[p].sum() + 1) for p in parts) - g.sum() ** 2 / (h.sum() + 1)

    best = max(((gain(i, j), i, j) for i in range(1, 5) for j in range(1, 7)))
    assert np.allclose(q._quadrants(g, h), best)


def test_pairs_find_an_interaction():
    """An exclusive or has no main effects: only a pair's table can learn it."""
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 8, (4000, 4))
    y = ((bins[:, 1] > 3) ^ (bins[:, 2] > 3)).astype(float)
    held = np.arange(4000) % 5 == 0
    start, tables, grids = q.boost(bins, y, held, [8] * 4, 60, 2, 3, 0.3)
    assert (1, 2) in grids
    total = start + sum(t[bins[:, f]] for f, t in enumerate(tables)) + sum(g[bins[:, i], bins[:, j]] for (i, j), g in grids.items())
    assert ((total > 0) == (y > 0))[held].mean() > 0.97


def rows_of(spark):
    rng = np.random.default_rng(1)
    good = [(i, " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(60)) + ".") for i in range(0, 240)]
    bad = [(i, "word " * 50) if i % 2 else (i, " | ".join("tab" + str(k) for k in range(40))) for i in range(240, 400)]
    return good + bad


def test_learns_from_labels_and_ignores_the_rest(spark):
    rows = rows_of(spark)
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (901, ""), (None, "word word")], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("mine")).withColumn("x", F.lit(1)).withColumn("label", F.lit(0))
    labels = spark.createDataFrame([(i, int(i < 240)) for i in range(400) if i % 3] + [(1, 0), (None, 1), (2, None), (4, 7)], "doc_id long, quality int")
    model = q.fit(docs, labels, F.lit(True), rounds=40)
    out = q.score(docs, model).collect()
    assert len(out) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    judged = [(r.doc_id, r.predicted) for r in out if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 3 == 0]
    assert np.mean([p == int(i < 240) for i, p in judged]) > 0.97
    again = {r.doc_id: r.score for r in q.score(docs.repartition(7), q.fit(docs.repartition(5), labels, F.lit(True), rounds=40)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out)


def test_scores_are_sums_of_table_entries(spark):
    rows = rows_of(spark)[::7]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 240)) for i, _ in rows], "doc_id long, quality int")
    model = q.fit(docs, labels, F.lit(True), rounds=10, bags=3)
    for r in q.score(docs, model).collect():
        x = q.measure(pa.array([dict(rows)[r.doc_id]]))[0]
        bins = [int(sum(v >= e for e in edges)) for v, edges in zip(x, model.edges)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins)) + sum(g[bins[i]][bins[j]] for (i, j), g in model.grids.items())
        assert abs(1 / (1 + np.exp(-total)) - r.score) < 1e-9


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(r) for r in q.score(docs, q.fit(docs, none, F.lit(True))).collect()] == [(1, 0.0, 0), (2, 0.0, 0)]
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in q.score(docs, q.fit(docs, ones, F.lit(True))).collect()] == [(1, 1.0, 1), (2, 1.0, 1)]
    assert q.score(docs.limit(0), q.fit(docs.limit(0), ones, F.lit(True))).collect() == []


def test_held_out_ranking(spark):
    """Rows whose labels the model never saw."""
    from trialweave.llm.queries import LLM_QUERIES

    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = LLM_QUERIES["op13_quality"](spark, sf_dir).filter("held_out").join(labels, "doc_id").collect()
    assert area([r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]) > 0.9

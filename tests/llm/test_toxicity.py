import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trialweave.llm import toxicity as tox


def test_features_of_a_text():
    lexicon = tox.Lexicon(["idiot", "trash"])
    texts = ["You IDIOTS are trash!!!", "a nice day", "you 1d10t, tr@sh", None, "", "ü"]
    x = dict(zip(tox.FEATURES, tox.measure(pa.array(texts), lexicon).T))
    assert x["lexicon_hits"].tolist() == [2, 0, 0, 0, 0, 0]
    assert x["near_second_person"].tolist() == [2, 0, 0, 0, 0, 0]
    assert x["hidden_hits"].tolist() == [0, 0, 2, 0, 0, 0]
    assert x["lexicon_density"][0] == 2 / 4 and x["exclamations"][0] == 3 / len(texts[0])
    assert x["repeats"][0] == 1 / len(texts[0])  # the third of three equal signs
    assert np.allclose(x["capital_words"], [1 / 4, 0, 0, 0, 0, 0])
    assert all(np.isfinite(c).all() for c in x.values())


def test_features_do_not_depend_on_neighbours():
    lexicon = tox.Lexicon(["idiot"])
    texts = ["you", "idiot you", "", "!idiot", "you idiot" * 100]
    together = tox.measure(pa.array(texts), lexicon)
    alone = np.concatenate([tox.measure(pa.array([t]), lexicon) for t in texts])
    assert np.allclose(together, alone)


def test_learns_from_labels(spark):
    rows = [(i, f"some plain words number {i % 13} " * 5 + ("what a moron he is" if i % 4 == 0 else "what a day it is")) for i in range(400)]
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (901, ""), (None, "you moron")], "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(0, 0), (None, 1), (301, None), (302, 7)], "doc_id long, toxic int")
    model = tox.fit(docs, labels, F.lit(True))
    assert any(e.startswith("moro") for e in model.entries)
    out = tox.score(docs, model).collect()
    assert len(out) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in out if r.doc_id is not None and 300 <= r.doc_id < 400)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.fit(docs, labels, F.lit(True))
    assert [tuple(r) for r in tox.score(docs, model).collect()] == [(1, 0.0, 0)]


def test_held_out_ranking(spark, sf_dir):
    from trialweave.llm.queries import LLM_QUERIES

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = LLM_QUERIES["op8_toxicity"](spark, sf_dir).join(labels, "doc_id").collect()
    high = [r.score for r in rows if r.toxic == 1]
    low = [r.score for r in rows if r.toxic == 0]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in high for b in low])
    assert area > 0.7  # a few dozen labels here; above 0.98 on held-out rows of the larger tables

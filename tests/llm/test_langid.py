import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.llm import langid

SAMPLES = {
    "aa": "the cat sat on the mat and the dog ran to the house by the river " * 3,
    "bb": "der hund lief in das haus und die katze schlief auf dem sofa im zimmer " * 3,
}


def plain_phrases(text, sample, block=langid.BLOCK):
    """Greedy longest matches by substring search, restarted after each block of letters and spaces."""
    spaced = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in spaced:
        spaced = spaced.replace("  ", " ")
    spaced = spaced.lstrip(" ")
    known = langid._spaced(sample)
    count = 0
    for b in range(0, len(spaced), block):
        part, i, start = spaced[b : b + block], 0, True
        count += 1
        current = ""
        for c in part:
            if current + c in known:
                current += c
            else:
                count += 1
                current = c if c in known else ""
    return count, len(spaced)


@pytest.mark.parametrize("text", ["The cat and der Hund", "zzz 日本 the", "x" * 1000, "the cat sat on the mat. " * 40])
def test_phrases_match_substring_search(text):
    model = langid.build(SAMPLES)
    parser = langid.Parser(model)
    blocks, _, length = parser.blocks([text])
    for lang, table in zip(model.languages, model.tables):
        want, n = plain_phrases(text, SAMPLES[lang])
        assert length[0] == n
        assert int(parser.phrases(blocks, table).sum()) == want


def test_edge_texts(spark):
    rows = [(1, "the cat sat"), (2, None), (3, ""), (4, "123 !?"), (5, "Der Hund und die Katze"), (5, "Der Hund und die Katze"), (None, "the dog\0 ran")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = langid.identify(docs, langid.build(SAMPLES)).collect()
    found = [(r.doc_id, r.lang_pred) for r in out]
    assert sorted(found, key=str) == sorted([(1, "aa"), (2, "und"), (3, "und"), (4, "und"), (5, "bb"), (5, "bb"), (None, "aa")], key=str)
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.identify(docs.limit(0), langid.build(SAMPLES)).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "the cat", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert langid.identify(docs, model).first().lang_pred == "und"


def test_texts_do_not_influence_each_other():
    parser = langid.Parser(langid.build(SAMPLES))
    texts = ["the cat " * 300, "", "das haus im zimmer", "İ the", "the"]
    together = parser.predict(texts)
    alone = [parser.predict([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert np.allclose(together[1], [a[1][0] for a in alone])


def test_held_out_accuracy(spark, sf_dir):
    from trialweave.llm.queries import LLM_QUERIES

    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = LLM_QUERIES["op2_language"](spark, sf_dir).join(truth, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_packed_transitions_are_those_of_the_automaton():
    rng = np.random.default_rng(3)
    for letters, n in ((2, 400), (26, 3000), (3000, 5000)):
        step = langid.suffix_automaton((rng.zipf(1.3, n) % letters).tolist())
        table = langid.packed(step, letters + 2)
        for state, row in enumerate(step):
            codes = np.array([*row, *rng.integers(0, letters + 2, 5)])
            ahead, ended = table.step(np.full(len(codes), state), codes)
            assert [None if e else a for a, e in zip(ahead.tolist(), ended)] == [row.get(c) for c in codes.tolist()]


def test_size_follows_the_sample_not_the_alphabet():
    rng = np.random.default_rng(4)
    sample = "".join(chr(0x4E00 + c) for c in rng.zipf(1.2, 60_000) % 3000)
    table = langid.build({"zh": sample}).tables[0]
    assert sum(a.nbytes for a in (table.base, table.owner, table.target, table.start)) < 20 << 20


def test_languages_that_tie_go_to_the_first_name():
    model = langid.build({"b": "the cat", "a": "the cat"})
    assert langid.Parser(model).predict(["the cat", "dog"])[0] == ["a", "a"]

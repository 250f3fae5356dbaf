import re

import corpus_pipeline
from test_decontaminate import words


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.collect()
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    windows = {tuple(w[s : s + 13]) for b in benchmark for w in [words(b["text"])] for s in range(max(1, len(w) - 12))}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        if name == "language_id":
            assert ids == {r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or "")}
        elif name == "ngram_jaccard":
            sets = {r.doc_id: _shingles(r.text) for r in before}
            assert ids == _least_of_groups(sets)
        elif name == "decontamination":
            for r in before:
                w = words(r.text)
                hit = {p for s in range(len(w) - 12) if tuple(w[s : s + 13]) in windows for p in range(s, s + 13)}
                assert (r.doc_id in ids) == (not hit or 20 * len(hit) < len(w))
        elif name == "mixing":
            assert sorted(map(str, rows)) == sorted(map(str, before))
            order = [r.doc_id for r in rows]
        else:
            assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == order
            assert rows and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        if name != "token_output":
            assert out.columns == docs.columns
        docs, before = out, rows


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def _least_of_groups(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def test_edge_rows_pass_through(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    text = "the and of with by or as in on at is was are this that " * 3
    rows = [(1, text, "en", "a", 1, "s"), (2, text, None, None, None, "s"), (2, text, None, None, None, "s"), (3, None, "en", "a", 1, "s"), (4, "", "en", "a", 1, "s"), (None, text + " more", None, "b", 1, "s")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "token_output":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == [(False, 1), (True, 0)]


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_texts_that_share_an_id_all_stay(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["".join(f"{w}{k} " for w in ("alpha", "beta", "gamma", "delta", "omega")) for k in "abc"]
    docs = spark.createDataFrame([(1, texts[0], "en", "a", 1), (1, texts[1], "en", "a", 1), (1, texts[1], "en", "a", 1), (2, texts[2], "en", "a", 1)], schema)
    kept = corpus_pipeline.deduplicated(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, texts[0]), (1, texts[1]), (2, texts[2])]


def test_run_puts_the_session_back(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "1234")
    try:
        assert corpus_pipeline.run(spark, sf_dir).count() > 0 and spark.conf.get(key) == "1234"
    finally:
        spark.conf.unset(key)

import hashlib
import random
import re

import numpy as np

from trialweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_base_spans_match_the_plain_patterns():
    random.seed(7)
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112"]
    for _ in range(20_000):
        parts = [random.choice(["a", "b@", "@c.d", ".", "+", "-", "1", "25", "9", " ", "(", ")", "256", "٣", "ü", *cards]) for _ in range(random.randint(0, 14))]
        text = "".join(parts)
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000 + " x@y.zz", "1" * 300_000, "+1 " * 100_000, "1." * 100_000, "@" * 100_000):
        pii.base_spans(text)


P = pii.estimate(["mail ann@x.org now", "call +44 20 7946 0958 or +44 20 7946 0959", "id 1234567 is no phone", "orders 12345678, 23456789 and 34567890 came", "8.8.8.8 and 4111 1111 1111 1111"] * 20)


def test_similar_mentions_get_one_label():
    text = "call +44 20 7946 0958 today. " + "words " * 200 + "again: 44 20 7946 0958, order 99887766"
    base, spans = pii.tag([text], P)[0]
    assert [k for k, *_ in base] == ["phone"]
    assert ("phone", text.index("44 20 7946 0958,"), text.index(", order")) in spans
    assert len(spans) == 2  # the order number is like nothing else


def test_clean_text_stays_clean():
    base, spans = pii.tag(["order 99887766 of 2024-01-02, 1234567 units"], P)[0]
    assert base == spans == []


def test_marginals_match_enumeration():
    graph = pii.Graph()
    text = "+44 20 7946 0958 then 7946 0958 then 1234567"
    graph.add(0, text, pii.mentions(text, pii.base_spans(text)))
    n, k = len(graph.spans), 5
    unary = np.asarray(graph.shapes, float) @ P.weights
    total = np.zeros((k,) * n)
    for at in np.ndindex(*total.shape):
        if any(at[i] != label if label >= 0 else not graph.fits[i][at[i]] for i, label in enumerate(graph.labels)):
            total[at] = -np.inf
            continue
        total[at] = sum(unary[i, a] for i, a in enumerate(at) if graph.labels[i] < 0)
        total[at] += sum(P.chain[at[a], at[b]] for a, b in graph.chain) + sum(P.skip * (at[a] == at[b]) for a, b in graph.skip)
    weight = np.exp(total - total.max())
    got = graph.marginals(P, rounds=200)
    for i in range(n):
        want = weight.sum(axis=tuple(j for j in range(n) if j != i)) / weight.sum()
        assert np.abs(got[i] - want).max() < 0.1  # loops make it approximate
        assert got[i].argmax() == want.argmax()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "a@b.cc", "x"), (None, "é a@b.cc", "x")], "doc_id long, text string, spans string")
    out = {(r.doc_id, r.n_email): r for r in pii.find(docs, P).collect()}
    assert out[(1, 0)].base_sha256 == hashlib.sha256(b"").hexdigest() and out[(1, 0)].spans == ""
    assert out[(None, 1)].spans == "email:2:8"
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_runs_around_an_at_sign_in_linear_time():
    import random
    import re
    import time

    plain = re.compile(r"[^\s<>()\[\],;:\"']*@[^\s<>()\[\],;:\"']+")
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("ab@@. <,\n'") for _ in range(rng.randint(0, 30)))
        assert [m.span() for m in pii._AROUND_AT.finditer(text)] == [m.span() for m in plain.finditer(text)]
    start = time.perf_counter()
    for text in ("@ " + "a" * 1_000_000, "a" * 1_000_000 + "@", "@" * 1_000_000, "a@" * 500_000):
        list(pii._AROUND_AT.finditer(text))
    assert time.perf_counter() - start < 2


def test_sampled_mentions_are_those_of_the_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    graph = pii.sampled(docs, sample_docs=10**6)
    plain = pii.Graph()
    for i, row in enumerate(docs.filter("text is not null").collect()):
        plain.add(i, row.text, pii.mentions(row.text, pii.base_spans(row.text)))
    assert sorted(zip(graph.labels, map(str, graph.spans))) == sorted(zip(plain.labels, map(str, plain.spans)))
    assert (len(graph.chain), len(graph.skip)) == (len(plain.chain), len(plain.skip))
    assert pii.sampled(docs, sample_docs=3).owner[-1] <= 2


def test_hidden_spans_come_back(spark):
    # on a table with digit groups that are no personal data; a wrong mention is one the field adds
    graph = pii.sampled(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for plain, wanted in ((False, 0.9), (True, 0.5)):
        hidden, right, found = pii.hidden_found(graph, plain=plain)
        assert hidden > 100 and right >= wanted * hidden and right >= 0.9 * found
    _, without, _ = pii.hidden_found(graph, plain=True, skip=False)
    assert right >= without


def test_digits_that_fit_no_kind_are_left_alone():
    assert pii.fits("4111111111111112") == [True, False, False, True, False]
    assert pii.fits("4111111111111112", glued=True) == [True] + [False] * 4
    card = "4111 1111 1111 1111"
    text = f"{card} and {card[:-1]}2 4111 1111 1111 1112 and token4111111111111111x"
    base, spans = pii.tag([text], P)[0]
    assert all(b - a < 25 for _, a, b in spans)
    assert not pii.mentions("1" * 20, [])


def test_fitting_reads_bounded_mentions(spark):
    docs = spark.createDataFrame([(1, "1234567, " * 5000), (2, None), (3, "")], "doc_id long, text string")
    assert len(pii.sampled(docs).spans) == pii.MENTIONS_A_DOC
    assert pii.fit(docs.limit(0)).skip >= 0

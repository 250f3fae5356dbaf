from collections import Counter

import pytest

from trialweave.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 0.7, "b": 0.2, "c": 0.09, "d": 0.01}, {"a": 5}])
def test_every_source_stays_within_one_block(weights):
    shares = mixing.rounded(weights, 997)
    assert sum(shares.values()) == 997 and min(shares.values()) >= 1
    done = Counter()
    for t, source in enumerate(mixing.period(shares), 1):
        done[source] += 1
        for s, c in shares.items():
            assert abs(done[s] * 997 - c * t) < 997
    assert done == shares


def plain_schedule(blocks, weights, slots):
    """Slot by slot: earliest deadline first, phase by phase."""
    left, order = dict(blocks), []
    while any(left.values()):
        active = {s: weights[s] for s, n in left.items() if n}
        period, i = mixing.period(mixing.rounded(active, max(slots, 2 * len(active)))), 0
        while all(left[s] for s in active):
            order.append(period[i % len(period)])
            left[order[-1]] -= 1
            i += 1
    return order


def test_phases_match_the_slot_by_slot_schedule():
    blocks, weights = {"a": 130, "b": 17, "c": 60, "d": 1}, {"a": 2.0, "b": 1.0, "c": 3.0, "d": 0.1}
    order = plain_schedule(blocks, weights, 50)
    got = []
    for first, length, period, _ in mixing.phases(blocks, weights, 50):
        assert first == len(got)
        got += [period[i % len(period)] for i in range(length)]
    assert got == order and Counter(got) == blocks


def test_mix_keeps_all_rows_and_follows_the_schedule(spark):
    rows = [(i, "x" * (10 + i * 37 % 400), f"s{0 if i % 3 else i % 5}") for i in range(600)] + [(700, None, None), (701, "", None), (702, "y" * 5000, "s1"), (702, "y" * 5000, "s1"), (None, "z", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"s0": 1.0, "s1": 2.0, "s2": 1.0, "s3": 0.5}
    out = mixing.mix(docs, weights, block_chars=1000, slots=64).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in out) == Counter(rows)
    blocks = {(r.mix_slot, r.source) for r in out}
    assert len({s for s, _ in blocks}) == len(blocks)  # one block a slot
    assert {s for s, _ in blocks} == set(range(len(blocks)))  # no slot is empty
    count = Counter(s for _, s in blocks)
    first = plain_schedule({s: count[s] for s in weights}, weights, 64)
    assert [s for _, s in sorted(blocks, key=lambda x: x[0])][: len(first)] == first
    again = mixing.mix(docs, weights, block_chars=1000, slots=64).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0), weights).count() == 0

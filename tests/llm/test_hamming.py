import numpy as np
from pyspark.sql import functions as F

from trialweave.llm import hamming


def plain(rows, k):
    def code(v):
        if not v:
            return None
        sums = [0.0] * 64
        for i, x in enumerate(v):
            sums[i % 64] += 0.0 if x is None or x != x else x
        return sum(1 << i for i, s in enumerate(sums) if s > 0)

    coded = {(i, code(v)) for i, v in rows if i is not None and code(v) is not None}
    out = []
    for q, cq in coded:
        if q % 20 == 0:
            near = sorted({(bin(cq ^ c).count("1"), i) for i, c in coded if i != q})[:k]
            out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def searched(spark, rows, k=10, **more):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit("mine"))
    return sorted(tuple(r) for r in hamming.search(table, F.col("vec_id") % 20 == 0, k, **more).collect())


def vectors(seed, n, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [(i, (centres[i % 5] + rng.normal(size=dims) * rng.choice([0.05, 0.5, 2.0])).astype(float).tolist()) for i in range(n)]


def test_matches_all_pairs(spark):
    rows = vectors(1, 400)
    assert searched(spark, rows) == plain(rows, 10)


def test_blocks_ties_copies_and_edge_rows(spark):
    rows = vectors(2, 300, 70)
    rows += [(1000 + i, rows[20][1]) for i in range(60)]  # a code with many rows
    rows += [(2000, None), (2020, []), (None, rows[0][1]), (0, rows[0][1]), (2041, [None, 1.0]), (2040, [float("nan"), 1.0])]
    assert searched(spark, rows, 7, block_codes=40, query_codes=5) == plain(rows, 7)


def test_fewer_rows_than_asked_for(spark):
    rows = vectors(3, 4)
    assert searched(spark, rows) == plain(rows, 10)
    assert searched(spark, rows[:1]) == []
    assert searched(spark, []) == []


def test_radius_grows_only_as_needed(monkeypatch):
    seen = []
    real = hamming.flip_masks
    monkeypatch.setattr(hamming, "flip_masks", lambda r: seen.append(r) or real(r))
    rng = np.random.default_rng(4)
    code = rng.integers(0, 2**63, 500)
    tables = hamming.Tables(code, np.arange(500))
    q, c, d = tables.search(code[:3], 1)
    assert d.tolist() == [0, 0, 0] and max(seen) == 0  # distance 0 is covered at radius 0

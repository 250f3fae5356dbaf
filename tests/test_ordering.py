"""Splitting helpers on groups that span many tasks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trialweave.plans import exact_quantiles, hashed_rank, moments, neighbours, number_rows, running_sum


def skewed(spark, n=3000):
    """Group 0 holds most rows."""
    rng = np.random.default_rng(1)
    return pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n)),
            "x": rng.integers(0, 400, n).astype(float),
            "id": np.arange(n),
        }
    )


def test_number_rows_and_running_sum(spark):
    pdf = skewed(spark)
    df = spark.createDataFrame(pdf).repartition(7)
    want = pdf.sort_values(["g", "x", "id"])
    want["rn"] = want.groupby("g").cumcount() + 1
    want["running"] = want.groupby("g").x.cumsum()
    got = number_rows(df, ["g"], ["x", "id"]).toPandas().sort_values("id")
    assert got.rn.tolist() == want.sort_values("id").rn.tolist()
    got = running_sum(df, ["g"], ["x", "id"], "x").toPandas().sort_values("id")
    assert got.running.tolist() == want.sort_values("id").running.tolist()


def test_number_rows_descending(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": [1] * 50, "x": range(50)}))
    got = number_rows(df, ["g"], [F.desc("x")]).toPandas()
    assert (got.rn == 50 - got.x).all()


def test_neighbours_across_chunks(spark):
    pdf = pd.DataFrame({"g": [1] * 100 + [2] * 3, "i": [*range(5, 105), 0, 1, 2]})
    pdf["v"] = pdf.i * 10
    got = neighbours(spark.createDataFrame(pdf), ["g"], "i", {"p": ("v", -2), "n": ("v", 3)}, chunk=8)
    got = got.toPandas().sort_values(["g", "i"])
    assert len(got) == len(pdf)
    pd.testing.assert_series_equal(got.p.reset_index(drop=True), pdf.groupby("g").v.shift(2), check_names=False)
    pd.testing.assert_series_equal(got.n.reset_index(drop=True), pdf.groupby("g").v.shift(-3), check_names=False)


def test_hashed_rank_is_a_permutation(spark):
    df = spark.createDataFrame(skewed(spark))
    seed = F.concat_ws("|", F.lit("s"), F.col("id").cast("string"))
    got = hashed_rank(df, ["g"], seed, ["id"]).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part.rn) == list(range(1, len(part) + 1))
    assert got.sort_values("id").rn.tolist() == hashed_rank(df.repartition(5), ["g"], seed, ["id"]).toPandas().sort_values(
        "id"
    ).rn.tolist()


def test_exact_quantiles(spark):
    pdf = skewed(spark)
    pdf.loc[pdf.g == 0, "x"] = np.where(pdf[pdf.g == 0].id % 3 == 0, 5.0, pdf[pdf.g == 0].x)
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "x", {"a": 0.1, "m": 0.5, "z": 1.0}, bins=16)
    got = got.toPandas().set_index("g").sort_index()
    for name, q in (("a", 0.1), ("m", 0.5), ("z", 1.0)):
        np.testing.assert_allclose(got[name], pdf.groupby("g").x.quantile(q))


def test_quantiles_of_constant(spark):
    df = spark.createDataFrame([(1, 2.0)] * 4, "g int, x double")
    assert exact_quantiles(df, ["g"], "x", {"m": 0.5}).first().m == 2.0


def test_moments(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    df = spark.createDataFrame([(i % 3, row.tolist()) for i, row in enumerate(x)], "k int, vec array<double>")
    for row in moments(df.repartition(6), ["k"], "vec").collect():
        part = x[np.arange(200) % 3 == row.k]
        assert row.n == len(part)
        np.testing.assert_allclose(row.total, part.sum(axis=0))
        np.testing.assert_allclose(np.reshape(row.gram, (5, 5)), part.T @ part)

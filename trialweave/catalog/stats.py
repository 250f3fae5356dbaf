"""Queries on statistics, folds, scores and label sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import numeric
from ..operators import stats as st
from .registry import query

R = numeric.rounded
N_PERM = 199

_OBS = """obs AS (SELECT channel, trial * 2 + CASE WHEN t >= 20 THEN 1 ELSE 0 END AS obs, t >= 20 AS interest,
      avg(value) AS value FROM ep WHERE t < 10 OR t >= 20 GROUP BY ALL)"""
_PERM = f"""d0 AS (SELECT channel, count(*) FILTER (interest) AS n_interest, count(*) FILTER (NOT interest) AS n_baseline,
      avg(value) FILTER (interest) - avg(value) FILTER (NOT interest) AS difference FROM obs GROUP BY channel),
    rk AS (SELECT channel, perm, value, row_number() OVER (PARTITION BY channel, perm
        ORDER BY md5('42|' || perm || '|' || channel || '|' || obs), obs) AS rn
      FROM obs, range(1, {N_PERM + 1}) AS r(perm)),
    nul AS (SELECT channel, perm, avg(value) FILTER (rn <= n_interest) - avg(value) FILTER (rn > n_interest) AS d
      FROM rk JOIN d0 USING (channel) GROUP BY ALL),
    pv AS (SELECT channel, n_interest, n_baseline, difference,
      (count(*) FILTER (d >= difference - 1e-9) + 1) / {N_PERM + 1}.0::DOUBLE AS p
      FROM nul JOIN d0 USING (channel) GROUP BY ALL)"""


def _observations(spark, sf):
    rows = b.epochs(spark, sf)
    interest = F.col("t") >= 20
    return (
        rows.filter((F.col("t") < 10) | interest)
        .groupBy("channel", "trial", interest.alias("interest"))
        .agg(F.avg("value").alias("value"))
        .select(
            "channel", (F.col("trial") * 2 + F.col("interest").cast("int")).alias("obs"), "interest", "value"
        )
    )


@query(
    "perm_test",
    f"""WITH {b.EPOCHS_SQL}, {_OBS}, {_PERM} SELECT channel, n_interest, n_baseline,
      round(difference, 6) + 0.0 AS difference, round(p, 6) AS p FROM pv""",
)
def perm_test(spark, sf):
    out = st.permutation_test(_observations(spark, sf), ["channel"], "obs", N_PERM, draws="md5")
    return out.withColumn("difference", R(F.col("difference"))).withColumn("p", R(F.col("p")))


_FDR = """rp AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM pv),
    fdr AS (SELECT * EXCLUDE (r, n), least(1.0, min(p * n / r) OVER (ORDER BY r DESC)) AS q FROM rp)"""


@query(
    "sig_channels",
    f"""WITH {b.EPOCHS_SQL}, {_OBS}, {_PERM}, {_FDR} SELECT channel, round(q, 6) AS q FROM fdr WHERE q < 0.9""",
)
def sig_channels(spark, sf):
    pvalues = st.permutation_test(_observations(spark, sf), ["channel"], "obs", N_PERM, draws="md5")
    return st.significant_channels(pvalues, alpha=0.9).select("channel", R(F.col("q")).alias("q"))


@query(
    "fdr_bh",
    """WITH pv AS (SELECT c_nationkey AS subject, c_custkey AS channel,
      abs(c_acctbal - 4000) / 10000 AS p FROM customer),
    rp AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY p) AS r,
      count(*) OVER (PARTITION BY subject) AS n FROM pv)
    SELECT subject, channel, round(p, 6) AS p, round(least(1.0, min(p * n / r) OVER (
      PARTITION BY subject ORDER BY r DESC)), 6) AS q FROM rp""",
)
def fdr_bh(spark, sf):
    pvalues = b.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("subject"), F.col("c_custkey").alias("channel"),
        (F.abs(F.col("c_acctbal") - 4000) / 10000).alias("p"),
    )
    out = st.false_discovery(pvalues, ["subject"])
    return out.withColumn("p", R(F.col("p"))).withColumn("q", R(F.col("q")))


_KFOLD = """big AS (SELECT subject, max(n) AS m FROM (SELECT subject, label, count(*) AS n FROM feat GROUP BY ALL)
      GROUP BY subject),
    kf AS (SELECT subject, trial, label, CAST((row_number() OVER (PARTITION BY subject
      ORDER BY CASE WHEN m >= 5 THEN label END, md5('42|' || trial), trial) - 1) % 5 AS INTEGER) AS fold
      FROM feat JOIN big USING (subject))"""


@query("kfold", f"WITH {b.FEATURES_SQL}, {_KFOLD} SELECT * FROM kf")
def kfold(spark, sf):
    rows = b.features(spark, sf).select("subject", "trial", "label")
    return st.stratified_folds(rows, "trial", 5, keys=["subject"])


@query(
    "chance_labels",
    f"""WITH {b.FEATURES_SQL}, {_KFOLD}, tr AS (SELECT subject, trial, label, test_fold FROM kf, range(5) r(test_fold)
      WHERE fold <> test_fold),
    x AS (SELECT *, row_number() OVER (PARTITION BY subject, test_fold
      ORDER BY md5('42a|' || subject || '|' || test_fold || '|' || trial), trial) AS rn FROM tr),
    y AS (SELECT *, row_number() OVER (PARTITION BY subject, test_fold
      ORDER BY md5('42b|' || subject || '|' || test_fold || '|' || trial), trial) AS rn FROM tr)
    SELECT x.subject, CAST(x.test_fold AS INTEGER) AS test_fold, x.trial, y.label FROM x JOIN y USING (subject, test_fold, rn)""",
)
def chance_labels(spark, sf):
    rows = b.features(spark, sf).select("subject", "trial", "label")
    folded = st.stratified_folds(rows, "trial", 5, keys=["subject"])
    return st.chance_labels(folded, "trial", 5, keys=["subject"])


@query(
    "class_weight",
    f"""WITH {b.FEATURES_SQL}, c AS (SELECT subject, label, count(*) AS n_class FROM feat GROUP BY ALL)
    SELECT *, round(sum(n_class) OVER w / (count(*) OVER w * n_class), 6) AS weight FROM c
    WINDOW w AS (PARTITION BY subject)""",
)
def class_weight(spark, sf):
    out = st.class_weights(b.features(spark, sf), ["subject"])
    return out.withColumn("weight", R(F.col("weight")))


_PRED = """pr AS (SELECT vec_id % 3 AS iter, label AS y, CASE WHEN vec_id % 7 < 3 THEN label
    ELSE (label + vec_id) % 10 END AS y_pred FROM embeddings)"""


def _predictions(spark, sf):
    key, label = F.col("vec_id"), F.col("label")
    return b.table(spark, sf, "embeddings").select(
        (key % 3).alias("iter"), label.alias("y"),
        F.when(key % 7 < 3, label).otherwise((label + key) % 10).alias("y_pred"),
    )


@query(
    "balanced_accuracy",
    f"""WITH {_PRED}, r AS (SELECT iter, y, avg(CAST(y = y_pred AS INTEGER)) AS recall FROM pr GROUP BY ALL)
    SELECT iter, round(avg(recall), 6) AS score FROM r GROUP BY iter""",
)
def balanced_accuracy(spark, sf):
    return st.balanced_accuracy(_predictions(spark, sf), ["iter"]).withColumn("score", R(F.col("score")))


@query(
    "accuracy",
    f"WITH {_PRED} SELECT iter, round(avg(CAST(y = y_pred AS INTEGER)), 6) AS score FROM pr GROUP BY iter",
)
def accuracy(spark, sf):
    return st.accuracy(_predictions(spark, sf), ["iter"]).withColumn("score", R(F.col("score")))


@query(
    "score_summary",
    f"""WITH {_PRED}, r AS (SELECT iter, y, avg(CAST(y = y_pred AS INTEGER)) AS recall FROM pr GROUP BY ALL),
    s AS (SELECT iter, avg(recall) AS score FROM r GROUP BY iter)
    SELECT 'all' AS run, count(*) AS n_iter, round(avg(score), 6) AS mean_score,
      round(stddev_pop(score), 6) AS std_score FROM s""",
)
def score_summary(spark, sf):
    scores = st.balanced_accuracy(_predictions(spark, sf), ["iter"]).withColumn("run", F.lit("all"))
    out = st.score_summary(scores, ["run"])
    return out.withColumn("mean_score", R(F.col("mean_score"))).withColumn("std_score", R(F.col("std_score")))


_CORR = """a AS (SELECT label, ch, t, avg(value) AS a FROM fl WHERE subject = 0 GROUP BY ALL),
    o AS (SELECT subject AS source, label, ch, t, avg(value) AS v FROM fl WHERE subject > 0 GROUP BY ALL),
    c AS (SELECT source, label, ch, corr(a, v) AS r FROM o JOIN a USING (label, ch, t) GROUP BY ALL)"""


_CORR_ALL = """a AS (SELECT label, ch, t, avg(value) AS a FROM fl WHERE subject = 0 GROUP BY ALL),
    o AS (SELECT label, ch, t, avg(value) AS v FROM fl WHERE subject > 0 GROUP BY ALL),
    c AS (SELECT label, ch, corr(a, v) AS r FROM o JOIN a USING (label, ch, t) GROUP BY ALL)"""


@query(
    "pt_corr",
    f"WITH {b.FEATURES_SQL}, {_CORR_ALL} SELECT label, round(avg(r), 6) + 0.0 AS r FROM c GROUP BY label",
)
def pt_corr(spark, sf):
    rows = b.features_long(spark, sf)
    out = st.class_correlation(rows.filter("subject = 0"), rows.filter("subject > 0"), 8)
    return out.withColumn("r", R(F.col("r")))


@query(
    "pt_corr_multi",
    f"WITH {b.FEATURES_SQL}, {_CORR} SELECT source, label, round(avg(r), 6) + 0.0 AS r FROM c GROUP BY ALL",
)
def pt_corr_multi(spark, sf):
    rows = b.features_long(spark, sf)
    sources = rows.filter("subject > 0").withColumnRenamed("subject", "source")
    out = st.class_correlation(rows.filter("subject = 0"), sources, 8, ["source"])
    return out.withColumn("r", R(F.col("r")))


@query(
    "shared_labels",
    f"""WITH {b.FEATURES_SQL} SELECT label, trial, subject FROM feat WHERE subject > 0 AND label IN (
      SELECT label FROM feat WHERE subject = 0 AND vec[1] > 0.25)""",
)
def shared_labels(spark, sf):
    rows = b.features(spark, sf)
    target = rows.filter((F.col("subject") == 0) & (F.get("vec", F.lit(0)) > 0.25))
    return st.shared_labels(rows.filter("subject > 0").select("label", "trial", "subject"), target)


@query(
    "shared_classes",
    """WITH p AS (SELECT DISTINCT c_nationkey AS label, c_mktsegment AS subject FROM customer WHERE c_acctbal > 8000)
    SELECT label FROM p GROUP BY label HAVING count(*) = (SELECT count(DISTINCT subject) FROM p)""",
)
def shared_classes(spark, sf):
    rows = b.table(spark, sf, "customer").filter("c_acctbal > 8000").select(
        F.col("c_nationkey").alias("label"), F.col("c_mktsegment").alias("subject")
    )
    return st.shared_classes(rows)


@query(
    "trial_subselect",
    f"""WITH {b.FEATURES_SQL}, c AS (SELECT subject, label, count(*) AS n FROM feat GROUP BY ALL),
    l AS (SELECT label, min(n) AS least FROM c GROUP BY label HAVING count(*) = 4),
    r AS (SELECT subject, label, trial, row_number() OVER (PARTITION BY subject, label
      ORDER BY md5('42|' || trial), trial) AS pick FROM feat)
    SELECT r.* FROM r JOIN l USING (label) WHERE pick <= least""",
)
def trial_subselect(spark, sf):
    return st.trial_subselect(b.features(spark, sf).select("subject", "label", "trial"), "trial")

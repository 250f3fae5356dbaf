"""Queries on epochs: masks, rescaling, averages, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import codes, numeric
from ..operators import epochs as ep, quality as qc, stats as st
from .registry import query

R = numeric.rounded


def _round(df, column="value", digits=6):
    return df.withColumn(column, R(F.col(column), digits))


@query(
    "crop_window",
    f"""WITH {b.SIGNAL_SQL}, {b.DENSE_EPOCHS_SQL} SELECT subject, channel, trial, t, value FROM dep
    WHERE t BETWEEN 5 AND 15""",
)
def crop_window(spark, sf):
    rows = b.dense_epochs(spark, sf).withColumn("time", F.col("t") / 100.0 - 0.1)
    arrays = rows.groupBy("subject", "channel", "trial").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda s: s["value"]).alias("values")
    )
    cropped = ep.crop_arrays(arrays, -0.1, 100.0, -0.05, 0.05)
    return cropped.select("subject", "channel", "trial", F.posexplode("values").alias("t", "value")).withColumn(
        "t", F.col("t") + 5
    )


@query(
    "window_index",
    f"""WITH {b.SIGNAL_SQL}, {b.DENSE_EPOCHS_SQL}, w AS (SELECT DISTINCT t FROM dep
      WHERE (CASE WHEN t = 24 THEN 1.0 ELSE t * (2.0::DOUBLE / 24) - 1.0 END) BETWEEN -0.5 AND 0.5)
    SELECT t, round(avg(value), 6) AS value, count(*) AS n FROM dep WHERE t IN (SELECT t FROM w) GROUP BY t""",
)
def window_index(spark, sf):
    time = numeric.window_time(F.col("t"), b.TRIAL_SAMPLES, -1.0, 1.0)
    rows = b.dense_epochs(spark, sf).filter(numeric.in_window(time, (-0.5, 0.5)))
    return _round(rows.groupBy("t").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")))


_M1 = """pk AS (SELECT channel, trial, max(abs(value)) AS peak FROM ep GROUP BY ALL),
    lim AS (SELECT channel, 1.7::DOUBLE * stddev_pop(abs(value)) + avg(abs(value)) AS lim FROM ep GROUP BY channel),
    good AS (SELECT channel, trial, peak < lim AND peak <> 0 AS is_good FROM pk JOIN lim USING (channel))"""
_EP1 = b.EPOCHS_SQL.replace("l_suppkey", "l_partkey")


def _epochs_by_part(spark, sf):
    rows = b.table(spark, sf, "lineitem")
    return rows.select(
        F.concat(F.lit("E"), F.col("l_linenumber").cast("string")).alias("channel"),
        F.col("l_partkey").alias("trial"), F.col("l_quantity").alias("value"),
    )


def _mask(spark, sf):
    return qc.good_trials_amplitude(_epochs_by_part(spark, sf), 1.7)


@query("good_trials_m1", f"WITH {_EP1}, {_M1} SELECT * FROM good")
def good_trials_m1(spark, sf):
    return _mask(spark, sf)


@query(
    "good_trials_m2",
    f"""WITH {b.SIGNAL_SQL}, {b.DENSE_EPOCHS_SQL}, d AS (SELECT subject, channel, trial,
      value - lag(value) OVER (PARTITION BY subject, channel, trial ORDER BY t) AS step FROM dep)
    SELECT subject, channel, trial, max(abs(step)) < 420000 AS is_good, max(step) < 420000 AS is_good_signed
    FROM d GROUP BY ALL""",
)
def good_trials_m2(spark, sf):
    rows = b.dense_epochs(spark, sf)
    keys = ["subject", "channel"]
    signed = qc.good_trials_step(rows, 420000.0, keys, signed=True).withColumnRenamed("is_good", "is_good_signed")
    return qc.good_trials_step(rows, 420000.0, keys).join(signed, [*keys, "trial"])


@query(
    "good_trial_counts",
    f"""WITH {_EP1}, {_M1} SELECT channel, count(*) FILTER (is_good) AS n_good FROM good GROUP BY channel""",
)
def good_trial_counts(spark, sf):
    return qc.good_trial_counts(_mask(spark, sf))


@query(
    "good_trial_summary",
    f"""WITH {_EP1}, {_M1}, c AS (SELECT channel, count(*) FILTER (is_good) AS n FROM good GROUP BY channel)
    SELECT min(n) AS min_good, max(n) AS max_good, round(avg(n), 6) AS mean_good FROM c""",
)
def good_trial_summary(spark, sf):
    return _round(qc.good_trial_summary(_mask(spark, sf)), "mean_good")


@query(
    "good_trials_common",
    f"""WITH {_EP1}, {_M1} SELECT trial, count(*) FILTER (is_good)
      >= 0.8::DOUBLE * (SELECT count(DISTINCT channel) FROM good) AS is_good FROM good GROUP BY trial""",
)
def good_trials_common(spark, sf):
    return qc.good_trials_common(_mask(spark, sf), 0.8)


@query(
    "apply_mask",
    f"""WITH {b.SIGNAL_SQL}, {b.DENSE_EPOCHS_SQL}, m AS (SELECT subject, channel, trial, max(abs(value)) < 490000 AS g
      FROM dep GROUP BY ALL)
    SELECT subject, channel, trial, t, CASE WHEN g THEN value END AS value
    FROM dep JOIN m USING (subject, channel, trial)""",
)
def apply_mask(spark, sf):
    rows = b.dense_epochs(spark, sf).select("subject", "channel", "trial", "t", "value")
    mask = rows.groupBy("subject", "channel", "trial").agg(
        (F.max(F.abs("value")) < 490000).alias("is_good")
    )
    return ep.apply_mask(rows, mask, ["subject", "channel", "trial"])


@query(
    "expand_mask",
    """SELECT o_orderkey % 3 AS subject, o_orderkey // 3 AS phoneme, o_orderkey // 3 // 3 AS trial, c.g AS is_good
    FROM orders JOIN (SELECT o_orderkey % 3 AS subject, o_orderkey // 3 // 3 AS trial, max(o_totalprice) < 450000 AS g
      FROM orders GROUP BY ALL) c ON c.subject = o_orderkey % 3 AND c.trial = o_orderkey // 3 // 3""",
)
def expand_mask(spark, sf):
    key = F.col("o_orderkey")
    rows = b.table(spark, sf, "orders").select(
        F.pmod(key, F.lit(3)).alias("subject"), F.floor(key / 3).alias("phoneme"), "o_totalprice"
    )
    mask = rows.groupBy("subject", F.floor(F.col("phoneme") / 3).alias("trial")).agg(
        (F.max("o_totalprice") < 450000).alias("is_good")
    )
    return ep.expand_mask(rows.drop("o_totalprice"), mask, 3, ["subject"])


_BASE = "base AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS s FROM ep WHERE t < 10 GROUP BY channel)"


@query(
    "rescale_zscore",
    f"""WITH {b.EPOCHS_SQL}, {_BASE} SELECT channel, trial, t, count(*) AS n, round(avg((value - m) / s), 6) + 0.0 AS value
    FROM ep JOIN base USING (channel) GROUP BY ALL""",
)
def rescale_zscore(spark, sf):
    rows = b.epochs(spark, sf)
    out = ep.rescale(rows, rows.filter("t < 10"), ["channel"], "zscore")
    out = out.groupBy("channel", "trial", "t").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
    return _round(out)


@query(
    "rescale_mean",
    f"""WITH {b.EPOCHS_SQL}, {_BASE} SELECT channel, trial, t, count(*) AS n, round(avg(value - m), 6) + 0.0 AS value
    FROM ep JOIN base USING (channel) GROUP BY ALL""",
)
def rescale_mean(spark, sf):
    rows = b.epochs(spark, sf)
    out = ep.rescale(rows, rows.filter("t < 10"), ["channel"], "mean")
    out = out.groupBy("channel", "trial", "t").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
    return _round(out)


@query(
    "erp_mean",
    f"WITH {b.EPOCHS_SQL} SELECT channel, t, round(avg(value), 6) AS value FROM ep GROUP BY ALL",
)
def erp_mean(spark, sf):
    return _round(ep.trial_average(b.epochs(spark, sf)))


@query(
    "channel_values",
    f"""WITH {b.EPOCHS_SQL} SELECT channel, round(avg(value), 6) AS value FROM ep WHERE t BETWEEN 10 AND 30
    GROUP BY ALL""",
)
def channel_values(spark, sf):
    return _round(ep.channel_values(b.epochs(spark, sf), window=(10, 30)))


@query(
    "window_mean",
    f"""WITH {b.EPOCHS_SQL} SELECT channel, trial, round(avg(value), 6) AS value FROM ep WHERE t >= 10 AND t < 30
    GROUP BY ALL""",
)
def window_mean(spark, sf):
    return _round(ep.window_mean(b.epochs(spark, sf), 10, 30))


@query(
    "class_average",
    f"""WITH {b.FEATURES_SQL} SELECT subject, label, CAST(ch * 8 + t AS INTEGER) AS pos, round(avg(value), 6) + 0.0 AS value
    FROM fl GROUP BY ALL""",
)
def class_average(spark, sf):
    return _round(ep.class_average(b.features(spark, sf), ["subject", "label"]))


@query(
    "flatten_features",
    f"""WITH {b.FEATURES_SQL} SELECT trial, list(value ORDER BY t, ch) AS vec FROM fl GROUP BY trial""",
)
def flatten_features(spark, sf):
    return ep.flatten_features(b.features_long(spark, sf), ["trial"], ["t", "ch"])


def _masked_long(spark, sf):
    gone = (F.col("trial") * 7 + F.col("ch")) % 11 == 0
    return b.features_long(spark, sf).withColumn("value", F.when(~gone, F.col("value")))


_MASKED = "mk AS (SELECT trial, subject, label, ch, t, CASE WHEN (trial * 7 + ch) % 11 <> 0 THEN value END AS value FROM fl)"


@query(
    "impute_class",
    f"""WITH {b.FEATURES_SQL}, {_MASKED},
    c AS (SELECT subject, ch, label, t, avg(value) AS m, count(value) AS n FROM mk GROUP BY ALL),
    g AS (SELECT subject, ch, t, avg(value) AS m FROM mk GROUP BY ALL)
    SELECT mk.subject, mk.trial, mk.ch, mk.t, round(coalesce(value, CASE WHEN c.n >= 2 THEN c.m ELSE g.m END), 6) + 0.0 AS value
    FROM mk JOIN c USING (subject, ch, label, t) JOIN g USING (subject, ch, t)""",
)
def impute_class(spark, sf):
    gone = (F.col("trial") * 7 + F.col("ch")) % 11 == 0
    rows = ep.flatten_features(b.features_long(spark, sf), ["subject", "trial", "label", "ch"], ["t"])
    rows = rows.select("subject", "trial", "label", "ch", F.when(~gone, F.col("vec")).alias("values"))
    out = ep.impute_by_class(rows, ["subject", "ch"])
    out = out.select("subject", "trial", "ch", F.posexplode("values").alias("t", "value"))
    return _round(out)


@query(
    "impute_mean",
    f"""WITH {b.FEATURES_SQL}, {_MASKED}, f AS (SELECT ch, t, avg(value) AS m FROM mk WHERE label < 7 GROUP BY ALL)
    SELECT trial, mk.ch, mk.t, round(coalesce(value, m), 6) + 0.0 AS value FROM mk JOIN f USING (ch, t)""",
)
def impute_mean(spark, sf):
    rows = _masked_long(spark, sf)
    out = ep.impute_by_mean(rows.filter("label < 7"), rows)
    return _round(out.select("trial", "ch", "t", "value"))


@query(
    "multi_subject",
    f"""WITH {b.FEATURES_SQL} SELECT subject, trial, label, CASE WHEN subject = 2 THEN '/alt' ELSE '/main' END AS root
    FROM feat WHERE subject IN (0, 2)""",
)
def multi_subject(spark, sf):
    rows = b.features(spark, sf).drop("vec")
    roots = rows.filter("subject = 2").select("subject", F.lit("/alt").alias("root")).distinct()
    return ep.load_subjects(rows, [0, 2], roots, "/main")


@query(
    "features_by_position",
    f"""WITH {b.FEATURES_SQL} SELECT subject, trial, trial // 4 % 3 + 1 AS position,
      ({list(codes.ARTICULATORS.values())})[label % 9 + 1] AS label FROM feat WHERE trial // 4 % 3 + 1 = 2""",
)
def features_by_position(spark, sf):
    rows = b.features(spark, sf).select(
        "subject", "trial", (F.pmod(F.floor(F.col("trial") / 4), F.lit(3)) + 1).alias("position"),
        (F.col("label") % 9 + 1).alias("label"),
    )
    return ep.features_by_position(rows, 2, "artic")


@query(
    "pool_rows",
    f"""WITH {b.FEATURES_SQL} SELECT subject, trial, label FROM feat WHERE subject = 0 UNION ALL
    SELECT subject, trial, label FROM feat WHERE subject <> 0 AND label IN (
      SELECT label FROM feat WHERE subject = 0)""",
)
def pool_rows(spark, sf):
    rows = b.features(spark, sf).drop("vec")
    target = rows.filter("subject = 0")
    return target.unionByName(st.shared_labels(rows.filter("subject <> 0"), target).select(*target.columns))

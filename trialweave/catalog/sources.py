"""Queries on sources: recording files and catalogs of stored files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions.numeric import rounded
from ..sources import recordings as rec, tables as tb
from .registry import query

_STORED = """stored AS (SELECT p_brand AS subject, p_type AS period,
      CASE WHEN p_size % 2 = 0 THEN 'highGamma' ELSE 'spikeBand' END AS suffix,
      CASE WHEN p_size > 25 THEN 'sig' ELSE 'all' END AS datatype, printf('%08d', p_partkey) || '.fif' AS path
      FROM part WHERE p_retailprice > 950)"""


@query(
    "feature_lookup",
    f"""WITH {_STORED}, req AS (SELECT DISTINCT p_brand AS subject, p_type AS period, f AS feature,
      CASE f WHEN 'high_gamma' THEN 'highGamma' ELSE 'spikeBand' END AS suffix
      FROM part, (VALUES ('high_gamma'), ('spike_band')) v(f)),
    best AS (SELECT subject, period, suffix, arg_min(datatype, k) AS datatype, arg_min(path, k) AS path FROM (
      SELECT *, CASE datatype WHEN 'sig' THEN '0' ELSE '1' END || path AS k FROM stored) GROUP BY ALL)
    SELECT subject, period, feature, suffix, datatype, path FROM req LEFT JOIN best USING (subject, period, suffix)""",
)
def feature_lookup(spark, sf):
    part = b.table(spark, sf, "part")
    stored = part.filter("p_retailprice > 950").select(
        F.col("p_brand").alias("subject"), F.col("p_type").alias("period"),
        F.when(F.col("p_size") % 2 == 0, "highGamma").otherwise("spikeBand").alias("suffix"),
        F.when(F.col("p_size") > 25, "sig").otherwise("all").alias("datatype"),
        F.format_string("%08d.fif", "p_partkey").alias("path"),
    )
    requests = part.select(F.col("p_brand").alias("subject"), F.col("p_type").alias("period")).distinct()
    requests = requests.withColumn("feature", F.explode(F.array(F.lit("high_gamma"), F.lit("spike_band"))))
    return tb.feature_lookup(requests, stored, ["sig", "all"])


@query(
    "missing_periods",
    """SELECT DISTINCT user_id AS subject, p AS period FROM events, (VALUES ('view'), ('click'), ('error')) v(p)
    EXCEPT SELECT user_id, event_type FROM events WHERE value > 50""",
)
def missing_periods(spark, sf):
    events = b.table(spark, sf, "events")
    requested = events.select(F.col("user_id").alias("subject")).distinct().withColumn(
        "period", F.explode(F.array(F.lit("view"), F.lit("click"), F.lit("error")))
    )
    existing = events.filter("value > 50").select(
        F.col("user_id").alias("subject"), F.col("event_type").alias("period")
    )
    return tb.missing_periods(requested, existing)


@query(
    "missing_inputs",
    """SELECT 'surf/' || c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders
    WHERE o_totalprice > 250000)""",
)
def missing_inputs(spark, sf):
    expected = b.table(spark, sf, "customer").select(
        F.concat(F.lit("surf/"), F.col("c_custkey").cast("string")).alias("path")
    )
    found = b.table(spark, sf, "orders").filter("o_totalprice > 250000").select(
        F.concat(F.lit("surf/"), F.col("o_custkey").cast("string")).alias("path")
    )
    return tb.missing_inputs(expected, found)

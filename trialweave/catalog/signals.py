"""Queries on recordings: scaling, timestamps, references, outliers, trial cutting."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import numeric
from ..operators import epochs as ep, signals as sg, table_functions as tf
from ..sources import recordings as rec
from .registry import query

R = numeric.rounded


@query(
    "scale_analog",
    """WITH w AS (SELECT o_orderkey, (['amplifier','aux','supply','temperature','adc'])[o_orderkey % 5 + 1] AS kind,
      ([0, 1, 13])[o_orderkey // 5 % 3 + 1] AS board_mode, o_orderkey * 7919 % 65536 AS raw FROM orders)
    SELECT o_orderkey, round(CASE kind WHEN 'amplifier' THEN 0.195::DOUBLE * (raw - 32768)
      WHEN 'aux' THEN 37.4e-6 * raw WHEN 'supply' THEN 74.8e-6 * raw WHEN 'temperature' THEN 0.01::DOUBLE * raw
      ELSE CASE board_mode WHEN 1 THEN 152.59e-6 * (raw - 32768) WHEN 13 THEN 312.5e-6 * (raw - 32768)
        ELSE 50.354e-6 * raw END END, 9) + 0.0 AS value FROM w""",
)
def scale_analog(spark, sf):
    key = F.col("o_orderkey")
    kinds = F.array(*[F.lit(k) for k in ("amplifier", "aux", "supply", "temperature", "adc")])
    modes = F.array(F.lit(0), F.lit(1), F.lit(13))
    rows = b.table(spark, sf, "orders").select(
        "o_orderkey",
        F.get(kinds, (key % 5).cast("int")).alias("kind"),
        F.get(modes, F.pmod(F.floor(key / 5), F.lit(3)).cast("int")).alias("board_mode"),
        (key * 7919 % 65536).alias("raw"),
    )
    value = numeric.scale_analog(F.col("raw"), F.col("kind"), F.col("board_mode"))
    return rows.select("o_orderkey", R(value, 9).alias("value"))


@query(
    "unpack_digital",
    """SELECT o_orderkey, bit, ((o_orderkey * 7919 % 65536) >> bit) & 1 = 1 AS level
    FROM orders, (SELECT CAST(range AS INTEGER) AS bit FROM range(16)) AS c""",
)
def unpack_digital(spark, sf):
    rows = b.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") * 7919 % 65536).alias("word")
    )
    bits = rows.withColumn("bit", F.explode(F.array(*[F.lit(k) for k in range(16)])))
    return bits.select("o_orderkey", "bit", numeric.digital_bit(F.col("word"), F.col("bit")).alias("level"))


_STAMPS = """st AS (SELECT o_orderkey % 4 AS file, o_orderkey // 4 AS idx,
    o_orderkey // 4 + CASE WHEN o_custkey % 50 = 0 THEN 1 ELSE 0 END AS timestamp FROM orders)"""


@query(
    "timestamp_gaps",
    f"""WITH {_STAMPS}, d AS (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY file ORDER BY idx) AS step
      FROM st)
    SELECT file, count(*) FILTER (step <> 1) AS n_gaps, min(timestamp) / 30000.0::DOUBLE AS t_first,
      max(timestamp) / 30000.0::DOUBLE AS t_last, count(*) FILTER (idx % 4 = 0) AS n_aux,
      count(*) FILTER (idx % 128 = 0) AS n_supply FROM d GROUP BY file""",
)
def timestamp_gaps(spark, sf):
    key = F.col("o_orderkey")
    idx = F.floor(key / 4)
    rows = b.table(spark, sf, "orders").select(
        F.pmod(key, F.lit(4)).alias("file"), idx.alias("idx"),
        (idx + F.when(F.col("o_custkey") % 50 == 0, 1).otherwise(0)).alias("timestamp"),
    )
    return sg.timestamp_gaps(rows, ["file"], 30000.0)


@query(
    "time_axes",
    f"""WITH {_STAMPS}, k AS (SELECT * FROM (VALUES ('amplifier', 1), ('adc', 1), ('digital', 1), ('aux', 4), ('supply', 128),
      ('temperature', 128)) AS v(kind, step))
    SELECT file, kind, idx // step AS idx, timestamp / 30000.0::DOUBLE AS t FROM st JOIN k ON idx % step = 0""",
)
def time_axes(spark, sf):
    key = F.col("o_orderkey")
    idx = F.floor(key / 4)
    rows = b.table(spark, sf, "orders").select(
        F.pmod(key, F.lit(4)).alias("file"), idx.alias("idx"),
        (idx + F.when(F.col("o_custkey") % 50 == 0, 1).otherwise(0)).alias("timestamp"),
    )
    return sg.time_axes(rows, ["file"], 30000.0)


@query(
    "file_range",
    """WITH f AS (SELECT source AS subject, 'sub' || source || '_' || printf('%08d', doc_id) || '.rhd' AS path
      FROM documents)
    SELECT subject, path, rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY path)
      AS rn FROM f) WHERE rn BETWEEN 3 AND 7""",
)
def file_range(spark, sf):
    files = b.table(spark, sf, "documents").select(
        F.col("source").alias("subject"),
        F.format_string("sub%s_%08d.rhd", "source", "doc_id").alias("path"),
    )
    return rec.file_range(files, 3, 7)


@query(
    "concat_offsets",
    """SELECT source AS subject, doc_id AS file, n_chars AS n_samples, CAST(coalesce(sum(n_chars) OVER (
      PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
      AS start_sample FROM documents""",
)
def concat_offsets(spark, sf):
    files = b.table(spark, sf, "documents").select(
        F.col("source").alias("subject"), F.col("doc_id").alias("file"), F.col("n_chars").alias("n_samples")
    )
    return rec.concat_offsets(files, ["file"])


@query(
    "load_raw_uv",
    f"""WITH {b.SIGNAL_SQL} SELECT subject, channel, sample, value * 1000000 AS value
    FROM sig WHERE subject IN (0, 2) AND contact <> 8""",
)
def load_raw_uv(spark, sf):
    rows = b.signal(spark, sf).withColumn(
        "channel", F.when(F.col("contact") == 8, "Trigger").otherwise(F.col("channel"))
    )
    return sg.load_microvolts(rows, [0, 2]).select("subject", "channel", "sample", "value")


@query(
    "unit_convert",
    """SELECT c_custkey, round(c_acctbal * ([1.0, 1e-3, 1e-6, 1e-9])[c_custkey % 4 + 1], 12) + 0.0 AS volts
    FROM customer""",
)
def unit_convert(spark, sf):
    units = F.array(*[F.lit(u) for u in ("V", "mV", "uV", "nV")])
    unit = F.get(units, (F.col("c_custkey") % 4).cast("int"))
    return b.table(spark, sf, "customer").select(
        "c_custkey", R(numeric.to_volts(F.col("c_acctbal"), unit), 12).alias("volts")
    )


@query(
    "resolve_fs",
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 6000 THEN 2000.0 END,
      CASE WHEN c_nationkey > 12 THEN 1000.0 END, 500.0)::DOUBLE AS fs FROM customer""",
)
def resolve_fs(spark, sf):
    rows = b.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 6000, F.lit(2000.0)).alias("fs_memory"),
        F.when(F.col("c_nationkey") > 12, F.lit(1000.0)).alias("fs_store"),
        F.lit(500.0).alias("fs_header"),
    )
    return sg.resolve_rate(rows, ["fs_memory", "fs_store", "fs_header"]).select("c_custkey", "fs")


@query(
    "rectify",
    """SELECT c_custkey, abs(v) AS magnitude, round(v * v, 4) AS power
    FROM (SELECT c_custkey, c_acctbal - 4000 AS v FROM customer)""",
)
def rectify(spark, sf):
    v = F.col("c_acctbal") - 4000
    return b.table(spark, sf, "customer").select(
        "c_custkey", F.abs(v).alias("magnitude"), R(v * v, 4).alias("power")
    )


_BAD = "(subject = 0 AND contact IN (2, 5)) OR (subject = 1 AND contact = 8)"


def _long(chunks, digits=4):
    return sg.to_long(chunks).select("subject", "channel", "sample", R(F.col("value"), digits).alias("value"))


@query(
    "ref_car",
    f"""WITH {b.SIGNAL_SQL}, m AS (SELECT subject, sample, avg(value) AS m FROM sig WHERE NOT ({_BAD})
      GROUP BY ALL)
    SELECT subject, channel, sample, round(CASE WHEN {_BAD} THEN value ELSE value - m END, 4) + 0.0 AS value
    FROM sig JOIN m USING (subject, sample)""",
)
def ref_car(spark, sf):
    bad = b.signal(spark, sf).filter(_BAD).select("subject", "channel").distinct()
    return _long(sg.reference_average(b.samples(spark, sf), bad))


@query(
    "ref_wm",
    f"""WITH {b.SIGNAL_SQL}, m AS (SELECT subject, sample, avg(value) AS m FROM sig
      WHERE CASE WHEN subject = 0 THEN contact IN (1, 4) ELSE contact IN (3, 6, 7) END GROUP BY ALL)
    SELECT subject, channel, sample, round(value - m, 4) + 0.0 AS value FROM sig JOIN m USING (subject, sample)""",
)
def ref_wm(spark, sf):
    status = (
        F.when((F.col("subject") == 0) & F.col("contact").isin(1, 4), "pure_white_matter")
        .when((F.col("subject") == 0) & (F.col("contact") == 2), "white_matter")
        .when((F.col("subject") > 0) & F.col("contact").isin(3, 6, 7), "white_matter")
    )
    channels = b.signal(spark, sf).select("subject", "channel", status.alias("status_description")).distinct()
    return _long(sg.reference_white_matter(b.samples(spark, sf), channels))


@query(
    "ref_laplacian",
    f"""WITH {b.SIGNAL_SQL}, n AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS x FROM sig
      WINDOW w AS (PARTITION BY subject, sample ORDER BY contact))
    SELECT subject, channel, sample, round(CASE WHEN p IS NULL AND x IS NULL THEN value
      WHEN p IS NULL THEN value - x WHEN x IS NULL THEN value - p
      ELSE value - 0.5::DOUBLE * (p + x) END, 4) + 0.0 AS value FROM n""",
)
def ref_laplacian(spark, sf):
    return _long(sg.reference_laplacian(b.samples(spark, sf)))


_ORDERED_SQL = """ord AS (SELECT 'E' || l_suppkey AS channel, l_extendedprice AS value,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS sample FROM lineitem)"""


def _ordered(spark, sf):
    from ..plans import number_rows

    order = [
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    rows = number_rows(b.table(spark, sf, "lineitem"), ["l_suppkey"], order, "sample")
    return rows.select(
        F.concat(F.lit("E"), F.col("l_suppkey").cast("string")).alias("channel"),
        F.col("l_extendedprice").alias("value"), "sample",
    )


@query(
    "detrend",
    f"""WITH {_ORDERED_SQL}, f AS (SELECT channel, regr_slope(value, sample) AS s, regr_intercept(value, sample) AS i
      FROM ord GROUP BY channel)
    SELECT channel, sample, round(value - (s * sample + i), 3) + 0.0 AS value FROM ord JOIN f USING (channel)""",
)
def detrend(spark, sf):
    out = sg.detrend(_ordered(spark, sf), ["channel"])
    return out.select("channel", "sample", R(F.col("value"), 3).alias("value"))


_OUTLIER_TAIL = """sp AS (SELECT subject, channel, stddev_pop(CASE WHEN r * r = 0 THEN 1e-9 ELSE r * r END) AS spread
      FROM res GROUP BY ALL),
    o1 AS (SELECT *, spread > {k} * stddev_pop(spread) OVER (PARTITION BY subject)
      + avg(spread) OVER (PARTITION BY subject) AS out1 FROM sp),
    l2 AS (SELECT subject, {k} * stddev_pop(spread) + avg(spread) AS lim FROM o1 WHERE NOT out1 GROUP BY subject)
    SELECT subject, channel, round(spread / 1e9, 6) AS spread FROM o1 LEFT JOIN l2 USING (subject)
    WHERE out1 OR spread > lim"""


@query(
    "channel_outliers",
    f"""WITH {b.SIGNAL_SQL}, f AS (SELECT subject, channel, regr_slope(value, sample) AS s,
      regr_intercept(value, sample) AS i FROM sig GROUP BY ALL),
    res AS (SELECT subject, channel, value - (s * sample + i) AS r FROM sig JOIN f USING (subject, channel)),
    {_OUTLIER_TAIL.format(k="1.0::DOUBLE")}""",
)
def channel_outliers(spark, sf):
    out = sg.channel_outliers(b.signal(spark, sf), threshold=1.0)
    return out.withColumn("spread", R(F.col("spread") / 1e9))


@query(
    "epoch_channel_outliers",
    f"""WITH {b.SIGNAL_SQL}, {b.DENSE_EPOCHS_SQL}, x AS (SELECT subject, channel, trial * 25 + t AS n, value FROM dep
      WHERE t BETWEEN 5 AND 20),
    f AS (SELECT subject, channel, regr_slope(value, n) AS s, regr_intercept(value, n) AS i FROM x GROUP BY ALL),
    res AS (SELECT subject, channel, value - (s * n + i) AS r FROM x JOIN f USING (subject, channel)),
    {_OUTLIER_TAIL.format(k="1.2::DOUBLE")}""",
)
def epoch_channel_outliers(spark, sf):
    rows = b.dense_epochs(spark, sf).filter("t between 5 and 20")
    rows = rows.withColumn("n", F.col("trial") * b.TRIAL_SAMPLES + F.col("t"))
    out = sg.channel_outliers(rows, index="n", threshold=1.2)
    return out.withColumn("spread", R(F.col("spread") / 1e9))


_EPOCH_SQL = f"""WITH {b.SIGNAL_SQL}, e AS (SELECT event_id, event_id % 3 AS subject, event_id // 16 AS s0 FROM events)
    SELECT event_id, e.subject, channel, round(sum(value), 4) AS total, arg_min(value, sample) AS first,
      arg_max(value, sample) AS last FROM e JOIN sig ON sig.subject = e.subject
      AND sample BETWEEN s0 - 10 AND s0 + 20 GROUP BY ALL HAVING count(*) = 31"""


@query("epoch_extract", _EPOCH_SQL)
def epoch_extract(spark, sf):
    events = b.table(spark, sf, "events").select(
        "event_id", F.pmod("event_id", F.lit(3)).alias("subject"),
        (F.floor(F.col("event_id") / 16) / F.lit(b.SIGNAL_FS)).alias("onset"),
    )
    out = ep.extract_epochs(events, b.samples(spark, sf), (-0.1, 0.2), b.SIGNAL_FS, b.CHUNK)
    return out.select(
        "event_id", "subject", "channel",
        R(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4).alias("total"),
        F.element_at("values", 1).alias("first"), F.element_at("values", -1).alias("last"),
    )


@query("epochs_table_function", _EPOCH_SQL)
def epochs_table_function(spark, sf):
    """The same epochs by the table function, called from SQL."""
    tf.register(spark)
    low = F.floor(F.col("event_id") / 16) - 10
    windows = b.table(spark, sf, "events").select(
        "event_id", F.pmod("event_id", F.lit(3)).alias("subject"), low.alias("lo"), (low + 31).alias("hi")
    )
    windows = windows.filter("lo >= 0")
    # events with one and the same window share its epochs
    pieces = tf.window_pieces(windows.drop("event_id").distinct(), b.samples(spark, sf), b.CHUNK)
    return spark.sql(
        """SELECT event_id, subject, channel, total, first, last FROM {windows} JOIN (
          SELECT subject, lo, channel, round(aggregate(values, 0.0D, (a, v) -> a + v), 4) AS total,
          element_at(values, 1) AS first, element_at(values, -1) AS last FROM epochs(TABLE({pieces}))) USING (subject, lo)""",
        pieces=pieces, windows=windows,
    )

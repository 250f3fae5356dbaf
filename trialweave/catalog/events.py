"""Queries on event tables and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import codes, numeric, text
from ..operators import events as ev
from .registry import query

WINDOW = 4 * 3600.0
R = numeric.rounded

KEPT_SQL = """kept AS (
  SELECT * FROM ev s WHERE trial_type <> 'stimulus' OR EXISTS (
    SELECT 1 FROM ev r WHERE r.trial_type = 'response' AND r.subject = s.subject
      AND r.onset > s.onset AND r.onset <= s.onset + 14400.0))"""


@query("drop_orphans", f"WITH {b.EVENTS_SQL}, {KEPT_SQL} SELECT * FROM kept")
def drop_orphans(spark, sf):
    return ev.drop_orphans(b.events(spark, sf), WINDOW)


@query(
    "trial_number",
    f"""WITH {b.EVENTS_SQL}, {KEPT_SQL}
    SELECT *, CAST(ceil(row_number() OVER (PARTITION BY subject ORDER BY onset, event_id) / 2) AS BIGINT)
      AS trial FROM kept""",
)
def trial_number(spark, sf):
    return ev.trial_numbers(ev.drop_orphans(b.events(spark, sf), WINDOW), 2, ["event_id"])


@query(
    "word_events",
    f"""WITH {b.EVENTS_SQL}, w AS (
      SELECT event_id, subject, trial_type, onset, onset + (value - 20) / 100 AS "offset" FROM ev
      WHERE trial_type IN ('stimulus', 'response'))
    SELECT event_id, subject, trial_type, onset,
      greatest(0.0::DOUBLE, "offset" - onset) AS duration, 'w' || event_id % 50 AS value,
      CAST(trunc(onset * 2000) AS BIGINT) AS sample FROM w""",
)
def word_events(spark, sf):
    lines = (
        b.events(spark, sf)
        .filter(F.col("trial_type").isin("stimulus", "response"))
        .select(
            "event_id", "subject", "trial_type",
            F.concat_ws(
                "\t",
                F.col("onset").cast("string"),
                (F.col("onset") + (F.col("value") - 20) / 100).cast("string"),
                F.concat(F.lit("w"), F.pmod("event_id", F.lit(50)).cast("string")),
            ).alias("line"),
        )
    )
    return ev.word_events(ev.parse_alignment(lines, "line"), 2000.0)


_PLAIN = "regexp_replace(label, '[0-9]', '', 'g')"
PHON_VALUE_SQL = (
    f"CASE {_PLAIN} " + " ".join(f"WHEN '{x}' THEN '{y}'" for x, y in codes.INGEST_SYMBOLS.items()) + f" ELSE {_PLAIN} END"
)

PHON_EVENTS_SQL = f"""pev AS (
  SELECT subject, (rn - 1) // 3 + 1 AS trial, onset, "offset" - onset AS duration,
    {PHON_VALUE_SQL} AS value,
    trial_type || '/' || ((rn - 1) % 3 + 1) AS trial_type,
    CAST(trunc(onset * 2000) AS BIGINT) AS sample
  FROM (SELECT *, row_number() OVER (PARTITION BY subject, trial_type ORDER BY onset, event_id) AS rn
        FROM ph))"""


@query("phoneme_events", f"WITH {b.EVENTS_SQL}, {b.PHONEMES_SQL}, {PHON_EVENTS_SQL} SELECT * FROM pev")
def phoneme_events(spark, sf):
    return ev.phoneme_events(b.phonemes(spark, sf), 3, 2000.0, "phoneme", ["onset", "event_id"])


@query(
    "prefer_corrected",
    f"""WITH {b.EVENTS_SQL}, c AS (
      SELECT *, CASE WHEN value > 60 THEN 0 ELSE 1 END AS priority FROM ev)
    SELECT * FROM c WHERE priority =
      (SELECT min(priority) FROM c d WHERE d.subject = c.subject AND d.trial_type = c.trial_type)""",
)
def prefer_corrected(spark, sf):
    rows = b.events(spark, sf).withColumn("priority", F.when(F.col("value") > 60, 0).otherwise(1))
    return ev.prefer_corrected(rows, ["subject", "trial_type"], "priority")


@query(
    "strip_stress",
    """SELECT p_partkey, regexp_replace(p_brand, '[0-9]', '', 'g') AS label FROM part""",
)
def strip_stress(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", text.strip_stress(F.col("p_brand")).alias("label"))


@query(
    "map_phoneme",
    f"""WITH {b.EVENTS_SQL}, {b.PHONEMES_SQL} SELECT event_id, label,
      {PHON_VALUE_SQL} AS value, regexp_replace(label, '[0-9]', '', 'g') AS lexical_value FROM ph""",
)
def map_phoneme(spark, sf):
    label = F.col("label")
    return b.phonemes(spark, sf).select(
        "event_id", "label",
        text.phoneme_value(label, F.lit("phoneme")).alias("value"),
        text.phoneme_value(label, F.lit("lexical")).alias("lexical_value"),
    )


_SYMBOLS = [*codes.DECODE_SYMBOLS, *codes.TARGET_CODES]


@query(
    "map_target_code",
    f"""SELECT event_id, ({_SYMBOLS})[event_id % {len(_SYMBOLS)} + 1] AS label,
      ({[codes.TARGET_CODES[codes.DECODE_SYMBOLS.get(x, x)] for x in _SYMBOLS]})[event_id % {len(_SYMBOLS)} + 1] AS code FROM events""",
)
def map_target_code(spark, sf):
    symbols = F.array(*[F.lit(x) for x in _SYMBOLS])
    rows = b.table(spark, sf, "events").select(
        "event_id", F.get(symbols, (F.col("event_id") % len(_SYMBOLS)).cast("int")).alias("label")
    )
    return rows.withColumn("code", text.target_code(F.col("label")))


_SEQ_SQL = """seq AS (SELECT vec_id, CAST([label % 9 + 1, (vec_id + label) % 9 + 1, vec_id % 9 + 1] AS INTEGER[])
  AS seq FROM embeddings)"""


def _sequences(spark, sf):
    label, key = F.col("label"), F.col("vec_id")
    return b.table(spark, sf, "embeddings").select(
        "vec_id",
        F.array(label % 9 + 1, (key + label) % 9 + 1, key % 9 + 1).cast("array<int>").alias("seq"),
    )


@query(
    "phoneme_to_artic",
    f"""WITH {_SEQ_SQL} SELECT vec_id, array_to_string(list_transform(seq,
      lambda x: ({list(codes.ARTICULATORS.values())})[x]), ',') AS artic FROM seq""",
)
def phoneme_to_artic(spark, sf):
    artic = text.articulator_sequence(F.col("seq"))
    return _sequences(spark, sf).select(
        "vec_id", F.array_join(artic.cast("array<string>"), ",").alias("artic")
    )


@query("label_seq_str", f"WITH {_SEQ_SQL} SELECT vec_id, array_to_string(seq, '') AS label FROM seq")
def label_seq_str(spark, sf):
    return _sequences(spark, sf).select("vec_id", text.label_string(F.col("seq")).alias("label"))


@query(
    "split_annotation",
    """SELECT event_id, event_type AS trial_type, 'w/' || props AS value FROM events""",
)
def split_annotation(spark, sf):
    rows = b.table(spark, sf, "events").select(
        "event_id", F.concat_ws("/", "event_type", F.lit("w"), "props").alias("note")
    )
    kind, value = text.split_annotation(F.col("note"))
    return rows.select("event_id", kind.alias("trial_type"), value.alias("value"))


@query("last_component", "SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages")
def last_component(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", text.last_component(F.col("url")).alias("name"))


@query("select_events", "SELECT event_id, event_type FROM events WHERE contains(event_type, 'i')")
def select_events(spark, sf):
    return ev.select_events(b.table(spark, sf, "events").select("event_id", "event_type"), "event_type", "i")


@query(
    "strip_entities",
    """SELECT c_custkey, 'sub-' || c_custkey || '_task-x_ieeg.' || lower(c_mktsegment) AS name FROM customer""",
)
def strip_entities(spark, sf):
    raw = F.concat(
        F.lit("sub-"), F.col("c_custkey").cast("string"), F.lit("_task-x_acq-"),
        F.col("c_nationkey").cast("string"), F.lit("_run-0"), F.col("c_nationkey").cast("string"),
        F.lit("_ieeg."), F.lower("c_mktsegment"),
    )
    return b.table(spark, sf, "customer").select("c_custkey", text.strip_entities(raw).alias("name"))


@query(
    "snake_to_camel",
    """WITH w AS (SELECT p_partkey, string_split(replace(p_name, ' ', '_') || '_' || p_type, '_') AS p FROM part)
    SELECT p_partkey, p[1] || array_to_string(list_transform(p[2:],
      lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '') AS camel FROM w""",
)
def snake_to_camel(spark, sf):
    snake = F.concat_ws("_", F.translate("p_name", " ", "_"), "p_type")
    return b.table(spark, sf, "part").select("p_partkey", text.snake_to_camel(snake).alias("camel"))


@query(
    "result_key",
    """WITH p AS (SELECT p_partkey, p_type, -(p_size / 10.0::DOUBLE) AS t0, p_size / 16.0::DOUBLE AS t1,
      CASE p_partkey % 3 WHEN 0 THEN 'perceptionZscore' WHEN 1 THEN 'productionMeanSub'
        ELSE 'production' END AS d,
      CASE WHEN p_partkey % 2 = 0 THEN 'epoch(band)(power)(sig)' ELSE 'epoch(band)(power)' END AS dt,
      CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE p_partkey % 7 END AS pos FROM part)
    SELECT p_partkey, lower(p_type) || '(' ||
      CASE WHEN contains(lower(d), 'perception') THEN 'Perception' ELSE 'Production' END || ')(' ||
      CASE WHEN contains(lower(d), 'zscore') THEN 'Zscore' WHEN contains(lower(d), 'meansub')
        THEN 'MeanSub' ELSE 'raw' END || ')(tw[' ||
      CASE WHEN t0 < 0 THEN 'pre' ELSE 'post' END || printf('%.2g', abs(t0)) || ',' ||
      CASE WHEN t1 < 0 THEN 'pre' ELSE 'post' END || printf('%.2g', abs(t1)) || '])(' ||
      CASE WHEN contains(dt, 'sig') THEN 'sig' ELSE 'all' END || 'Channel)' AS description,
      CASE WHEN pos = -1 THEN 'pAll' ELSE 'p' || pos END AS suffix FROM p""",
)
def result_key(spark, sf):
    key = F.col("p_partkey")
    rows = b.table(spark, sf, "part").select(
        "p_partkey",
        F.lower("p_type").alias("band"),
        (-(F.col("p_size") / F.lit(10.0))).alias("t0"),
        (F.col("p_size") / F.lit(16.0)).alias("t1"),
        F.when(key % 3 == 0, "perceptionZscore").when(key % 3 == 1, "productionMeanSub").otherwise(
            "production"
        ).alias("d"),
        F.when(key % 2 == 0, "epoch(band)(power)(sig)").otherwise("epoch(band)(power)").alias("dt"),
        F.when(key % 7 == 0, -1).otherwise(key % 7).alias("pos"),
    )
    return rows.select(
        "p_partkey",
        text.result_description(*[F.col(c) for c in ("band", "d", "t0", "t1", "dt")]).alias("description"),
        text.position_suffix(F.col("pos")).alias("suffix"),
    )


@query(
    "phonemes_per_trial",
    f"""WITH {b.EVENTS_SQL} SELECT subject,
      CASE subject % 3 WHEN 0 THEN 'lexical' WHEN 1 THEN 'phoneme' ELSE 'rest' END AS task,
      CASE subject % 3 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 5 END AS n_phons,
      count(*) FILTER (trial_type <> 'stimulus') // count(*) FILTER (trial_type = 'stimulus') AS derived
    FROM ev GROUP BY subject HAVING count(*) FILTER (trial_type = 'stimulus') > 0""",
)
def phonemes_per_trial(spark, sf):
    stim = F.count_if(F.col("trial_type") == "stimulus")
    counts = b.events(spark, sf).groupBy("subject").agg(
        stim.alias("s"), F.count_if(F.col("trial_type") != "stimulus").alias("o")
    )
    task = (
        F.when(F.col("subject") % 3 == 0, "lexical").when(F.col("subject") % 3 == 1, "phoneme").otherwise("rest")
    )
    return counts.filter("s > 0").select(
        "subject", task.alias("task"), numeric.phonemes_per_trial(task).alias("n_phons"),
        F.expr("o div s").alias("derived"),
    )


@query(
    "zip_trials",
    f"""WITH {b.EVENTS_SQL}, {b.PHONEMES_SQL}, n AS (
      SELECT *, row_number() OVER (PARTITION BY subject, trial_type ORDER BY onset, event_id) AS trial FROM ph)
    SELECT s.subject, s.trial, s.label AS stimulus, s.onset AS auditory_onset, s."offset" AS auditory_offset,
      r.onset AS response_onset, r."offset" AS response_offset
    FROM n s JOIN n r USING (subject, trial) WHERE s.trial_type = 'stimulus' AND r.trial_type = 'response'""",
)
def zip_trials(spark, sf):
    rows = b.phonemes(spark, sf).withColumnRenamed("label", "value")
    return ev.zip_trials(
        rows.filter(F.col("trial_type") == "stimulus"),
        rows.filter(F.col("trial_type") == "response"),
        ["onset", "event_id"],
    )


@query(
    "complete_trials",
    f"""WITH {b.EVENTS_SQL}, n AS (
      SELECT *, row_number() OVER (PARTITION BY subject ORDER BY onset, event_id) AS rn FROM ev),
    st AS (SELECT a.subject, a.rn FROM n a JOIN n b ON b.subject = a.subject AND b.rn = a.rn + 1
      JOIN n c ON c.subject = a.subject AND c.rn = a.rn + 2 JOIN n d ON d.subject = a.subject AND d.rn = a.rn + 3
      WHERE a.trial_type = 'signup' AND contains(b.trial_type, 'stim') AND contains(c.trial_type, 'resp')
        AND contains(d.trial_type, 'purch'))
    SELECT event_id, subject, onset, value, trial_type FROM n WHERE EXISTS (
        SELECT 1 FROM st WHERE st.subject = n.subject AND n.rn BETWEEN st.rn AND st.rn + 3)
      OR NOT EXISTS (SELECT 1 FROM st WHERE st.subject = n.subject)""",
)
def complete_trials(spark, sf):
    return ev.complete_trials(
        b.events(spark, sf), ["onset", "event_id"], "signup", ["stim", "resp", "purch"], name="trial_type"
    )


@query(
    "recode_events",
    f"""WITH {b.EVENTS_SQL}, {b.PHONEMES_SQL}, l AS (
      SELECT event_id, regexp_replace(label, '[0-9]', '', 'g') AS label FROM ph)
    SELECT event_id, label, CAST(dense_rank() OVER (ORDER BY label) AS INTEGER) AS code FROM l""",
)
def recode_events(spark, sf):
    rows = b.phonemes(spark, sf).select(
        "event_id", F.concat_ws("/", "trial_type", F.lit("1"), "label").alias("name")
    )
    return ev.recode_events(rows, "name").select("event_id", "label", "code")


@query(
    "align_labels",
    f"""WITH {b.EVENTS_SQL}, {b.PHONEMES_SQL}, {PHON_EVENTS_SQL},
    f AS (SELECT subject, trial, trial_type, onset, value AS label, split_part(trial_type, '/', 2) AS position
      FROM pev WHERE trial_type LIKE 'response/%')
    SELECT subject, trial, onset, label, position, first_value(label) OVER (
      PARTITION BY subject, trial ORDER BY position) AS align_label FROM f""",
)
def align_labels(spark, sf):
    rows = ev.phoneme_events(
        b.phonemes(spark, sf).filter(F.col("trial_type") == "response"),
        3, 2000.0, "phoneme", ["onset", "event_id"],
    )
    rows = rows.select(
        "subject", "trial", "onset", F.col("value").alias("label"),
        text.last_component(F.col("trial_type")).alias("position"),
    )
    return ev.align_labels(rows)


@query(
    "event_balance",
    f"""WITH {b.EVENTS_SQL} SELECT subject, count(*) FILTER (trial_type = 'stimulus') AS n_stimulus,
      count(*) FILTER (trial_type = 'response') AS n_response,
      count(*) FILTER (trial_type = 'stimulus') = count(*) FILTER (trial_type = 'response') AS balanced
    FROM ev GROUP BY subject""",
)
def event_balance(spark, sf):
    return ev.event_balance(b.events(spark, sf))


@query(
    "replace_events",
    f"""WITH {b.EVENTS_SQL}, s AS (SELECT * REPLACE ('response' AS trial_type) FROM ev
      WHERE trial_type = 'purchase' AND value > 50)
    SELECT * FROM ev e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.subject = e.subject
      AND s.trial_type = e.trial_type) UNION ALL SELECT * FROM s""",
)
def replace_events(spark, sf):
    rows = b.events(spark, sf)
    supplied = rows.filter((F.col("trial_type") == "purchase") & (F.col("value") > 50)).withColumn(
        "trial_type", F.lit("response")
    )
    return ev.replace_events(rows, supplied)


@query(
    "subject_pool",
    """SELECT DISTINCT 'S' || c_custkey AS subject FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey <> 7 ORDER BY subject""",
)
def subject_pool(spark, sf):
    segment = F.col("c_mktsegment")
    rows = b.table(spark, sf, "customer").select(
        F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("subject"),
        F.when(segment == "BUILDING", "phoneme").when(segment == "MACHINERY", "lexical").alias("cohort"),
    )
    return ev.subject_pool(rows.filter(F.col("cohort").isNotNull()), "S7", "all")


@query(
    "phoneme_slice",
    f"""WITH {b.EVENTS_SQL}, {b.PHONEMES_SQL}, {PHON_EVENTS_SQL}
    SELECT * FROM pev WHERE trial_type LIKE '%/2'""",
)
def phoneme_slice(spark, sf):
    rows = ev.phoneme_events(b.phonemes(spark, sf), 3, 2000.0, "phoneme", ["onset", "event_id"])
    index = (F.col("trial") - 1) * 3 + text.last_component(F.col("trial_type")).cast("int") - 1
    return ev.phoneme_slice(rows.withColumn("index", index), "index", 2, 3).drop("index")

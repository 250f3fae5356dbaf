"""Event tables: cleaning, numbering, sequence patterns, replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric, text
from ..plans import join_measured, measured, neighbours, number_rows

EVENT_COLUMNS = ["subject", "trial", "onset", "duration", "value", "trial_type", "sample"]


def drop_orphans(events: DataFrame, window_sec: float = 4.0) -> DataFrame:
    """Keep stimuli that have a response in ``(onset, onset + window_sec]``.

    Rows of other types always stay. No pair of rows is ever formed: time is cut into
    bins of half the window, responses shrink to the first and last onset of a bin,
    and a stimulus reads its own bin's last onset and the first onsets of the three
    bins after it. That decides the question exactly: a response in the own bin is
    always near enough, a response in a later bin is always later.
    """
    width = F.lit(window_sec / 2.0)
    kind = text.base_type(F.col("trial_type"))
    bins = (
        events.filter(kind == "response")
        .groupBy("subject", F.floor(F.col("onset") / width).alias("__bin"))
        .agg(F.min("onset").alias("__lo"), F.max("onset").alias("__hi"))
    )
    reach = (
        bins.withColumn("__back", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .groupBy("subject", (F.col("__bin") - F.col("__back")).alias("__bin"))
        .agg(
            F.max(F.when(F.col("__back") == 0, F.col("__hi"))).alias("__own_last"),
            F.min(F.when(F.col("__back") > 0, F.col("__lo"))).alias("__next_first"),
        )
    )
    tagged = events.withColumn(
        "__bin", F.when(kind == "stimulus", F.floor(F.col("onset") / width))
    )
    answered = (F.col("__own_last") > F.col("onset")) | (
        F.col("__next_first") <= F.col("onset") + F.lit(window_sec)
    )
    stimuli = tagged.filter(F.col("__bin").isNotNull())
    kept = stimuli.join(reach, ["subject", "__bin"], "inner").filter(F.coalesce(answered, F.lit(False)))
    others = tagged.filter(F.col("__bin").isNull())
    return kept.select(*events.columns).unionByName(others.select(*events.columns))


def trial_numbers(
    events: DataFrame, rows_per_trial: int = 2, tie: Sequence[str] = (), name: str = "trial"
) -> DataFrame:
    """``ceil(row / rows_per_trial)`` per subject after sorting by onset."""
    numbered = number_rows(events, ["subject"], ["onset", *tie], "__rn")
    return numbered.withColumn(
        name, F.ceil(F.col("__rn") / F.lit(rows_per_trial)).cast("long")
    ).drop("__rn")


def parse_alignment(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tab-separated ``onset, offset, label`` lines to typed columns."""
    parts = F.split(F.col(column), "\t")
    return lines.select(
        *[c for c in lines.columns if c != column],
        parts.getItem(0).cast("double").alias("onset"),
        parts.getItem(1).cast("double").alias("offset"),
        parts.getItem(2).alias("label"),
    )


def word_events(words: DataFrame, fs: float, clamp: bool = True) -> DataFrame:
    """Word alignments (subject, trial_type, onset, offset, label) to events without trial.

    ``clamp`` keeps durations from going below zero (first ingest); corrections keep
    the signed difference.
    """
    duration = F.col("offset") - F.col("onset")
    if clamp:
        duration = F.greatest(F.lit(0.0), duration)
    return words.select(
        *[c for c in words.columns if c not in ("onset", "offset", "label")],
        "onset",
        duration.alias("duration"),
        F.col("label").alias("value"),
        numeric.onset_sample(F.col("onset"), fs).alias("sample"),
    )


def phoneme_events(
    phonemes: DataFrame, n_phons: int, fs: float, task: str, order: Sequence[str]
) -> DataFrame:
    """Phoneme alignments to events: trial and position by row, label by symbol map.

    ``order`` is the row order of the alignment within (subject, trial_type).
    """
    numbered = number_rows(phonemes, ["subject", "trial_type"], list(order), "__rn")
    index = F.col("__rn") - 1
    return numbered.select(
        "subject",
        (F.floor(index / F.lit(n_phons)) + 1).cast("long").alias("trial"),
        "onset",
        (F.col("offset") - F.col("onset")).alias("duration"),
        text.phoneme_value(F.col("label"), F.lit(task)).alias("value"),
        F.concat_ws(
            "/", "trial_type", (F.pmod(index, F.lit(n_phons)) + 1).cast("long").cast("string")
        ).alias("trial_type"),
        numeric.onset_sample(F.col("onset"), fs).alias("sample"),
    )


def prefer_corrected(rows: DataFrame, keys: Sequence[str], priority: str) -> DataFrame:
    """Keep, per key, only the rows of the best source (lowest ``priority``)."""
    best = rows.groupBy(*keys).agg(F.min(priority).alias(priority))
    return rows.join(measured(best), [*keys, priority], "left_semi")


def select_events(events: DataFrame, name: str, part: str) -> DataFrame:
    return events.filter(text.contains(F.col(name), part))


def zip_trials(stimuli: DataFrame, responses: DataFrame, order: Sequence[str]) -> DataFrame:
    """Pair the n-th stimulus with the n-th response of a subject; the shorter side wins."""
    left = number_rows(stimuli, ["subject"], list(order), "trial").select(
        "subject", "trial", F.col("value").alias("stimulus"),
        F.col("onset").alias("auditory_onset"), F.col("offset").alias("auditory_offset"),
    )
    right = number_rows(responses, ["subject"], list(order), "trial").select(
        "subject", "trial",
        F.col("onset").alias("response_onset"), F.col("offset").alias("response_offset"),
    )
    return left.join(right, ["subject", "trial"])


def complete_trials(
    events: DataFrame,
    order: Sequence[str],
    start: str,
    parts: Sequence[str],
    name: str = "name",
    keep_all_if_none: bool = True,
) -> DataFrame:
    """Rows of complete trials: a ``start`` row followed by rows containing ``parts``.

    A subject without any complete trial is left as it is when ``keep_all_if_none``.
    """
    depth = len(parts)
    numbered = number_rows(events, ["subject"], list(order), "__rn")
    around = {f"__at{k}": (name, k) for k in range(-depth, depth + 1) if k}
    seen = neighbours(numbered, ["subject"], "__rn", around)

    def at(k: int) -> Column:
        return F.col(name) if k == 0 else F.col(f"__at{k}")

    def begins(k: int) -> Column:
        test = at(k) == start
        for i, part in enumerate(parts, 1):
            test = test & text.contains(at(k + i), part)
        return F.coalesce(test, F.lit(False))

    member = begins(0)
    for k in range(1, depth + 1):
        member = member | begins(-k)
    flagged = seen.select(*events.columns, member.alias("__in"))
    if not keep_all_if_none:
        return flagged.filter("__in").drop("__in")
    found = flagged.filter("__in").select("subject").distinct().withColumn("__any", F.lit(True))
    return (
        join_measured(flagged, found, ["subject"], "left")
        .filter(F.col("__in") | F.col("__any").isNull())
        .drop("__in", "__any")
    )


def recode_events(events: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Codes from 1 for the stress-free last components of ``name``, in alphabetical order.

    The ranking runs over the distinct labels only.
    """
    from pyspark.sql import Window

    labelled = events.withColumn("label", text.strip_stress(text.last_component(F.col(name))))
    labels = labelled.select(*by, "label").distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("label"))
    return join_measured(labelled, labels.withColumn("code", rank), [*by, "label"])


def event_balance(events: DataFrame) -> DataFrame:
    """Stimulus and response counts per subject and whether they agree."""
    kind = text.base_type(F.col("trial_type"))
    counts = events.groupBy("subject").agg(
        F.count_if(kind == "stimulus").alias("n_stimulus"),
        F.count_if(kind == "response").alias("n_response"),
    )
    return counts.withColumn("balanced", F.col("n_stimulus") == F.col("n_response"))


def replace_events(events: DataFrame, supplied: DataFrame) -> DataFrame:
    """Replace the event types present in ``supplied`` (per subject), keep the others."""
    given = supplied.select("subject", "trial_type").distinct()
    kept = events.join(measured(given), ["subject", "trial_type"], "left_anti")
    return kept.unionByName(supplied.select(*events.columns))


def subject_pool(subjects: DataFrame, target, pool: str) -> DataFrame:
    """Source subjects of a cross-subject run: ``phoneme``, ``lexical`` or ``all``, minus target.

    ``subjects`` has columns ``subject`` and ``cohort``.
    """
    if pool not in ("phoneme", "lexical", "all"):
        raise ValueError(f"unknown subject pool: {pool}")
    picked = subjects if pool == "all" else subjects.filter(F.col("cohort") == pool)
    return picked.filter(F.col("subject") != F.lit(target)).select("subject").distinct().orderBy("subject")


def phoneme_slice(rows: DataFrame, index: str, position: int, n_phons: int) -> DataFrame:
    """Rows of one phoneme position (1-based) by 0-based row index; -1 keeps all."""
    if position == -1:
        return rows
    if not 1 <= position <= n_phons:
        raise ValueError(f"position must be between 1 and {n_phons}, got {position}")
    return rows.filter(F.pmod(F.col(index), F.lit(n_phons)) == position - 1)


def align_labels(phonemes: DataFrame, position: str = "position") -> DataFrame:
    """Add ``align_label``: the label at position 1 of the row's trial."""
    first = phonemes.filter(F.col(position) == 1).groupBy("subject", "trial").agg(
        F.min("label").alias("align_label")
    )
    return phonemes.join(first, ["subject", "trial"], "left")

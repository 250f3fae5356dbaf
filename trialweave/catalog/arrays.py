"""Queries on array kernels: filters, resampling, spectra, cues, triggers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import bindings as b
from ..functions.numeric import rounded as R
from ..operators import filters as fl, signals as sg, triggers as tg
from .registry import query

FS = b.SIGNAL_FS
LINE, TAPS = 12.0, fl.notch_length(b.SIGNAL_FS)


def _long(chunks, digits=4):
    return sg.to_long(chunks).select("subject", "channel", "sample", R(F.col("value"), digits).alias("value"))


def _values(numbers) -> str:
    return ", ".join(f"({i}, {float(x)!r}::DOUBLE)" for i, x in enumerate(numbers))


_N = "n AS (SELECT subject, channel, max(sample) + 1 AS n FROM sig GROUP BY ALL)"
# reflection about both edges, as often as needed
_FOLDED = "((s.sample + k) % (2 * n) + 2 * n) % (2 * n)"
_MIRRORED = f"CASE WHEN {_FOLDED} < n THEN {_FOLDED} ELSE 2 * n - 1 - {_FOLDED} END"


@query(
    "notch",
    f"""WITH {b.SIGNAL_SQL}, {_N}, h AS (SELECT i - {TAPS // 2} AS k, w FROM (VALUES
      {_values(fl.notch_taps(FS, LINE))}) AS v(i, w))
    SELECT s.subject, s.channel, s.sample, round(sum(w * x.value), 4) + 0.0 AS value
    FROM sig s JOIN n USING (subject, channel), h JOIN sig x ON x.subject = s.subject AND x.channel = s.channel
      AND x.sample = {_MIRRORED} GROUP BY ALL""",
)
def notch(spark, sf):
    return _long(fl.notch(b.samples(spark, sf), FS, LINE, chunk=b.CHUNK))


_B, _A = fl.iir_notch_coefficients(FS, 12.0, 10.0)


@query(
    "iir_notch",
    f"""WITH RECURSIVE {b.SIGNAL_SQL}, y AS (
      SELECT a.subject, a.channel, c.sample, a.value AS x2, c.value AS x1, a.value AS y2, c.value AS y1
      FROM sig a JOIN sig c USING (subject, channel) WHERE a.sample = 0 AND c.sample = 1
      UNION ALL SELECT y.subject, y.channel, s.sample, x1, s.value, y1,
        {_B[0]!r}::DOUBLE * s.value + {_B[1]!r}::DOUBLE * x1 + {_B[2]!r}::DOUBLE * x2
        - ({_A[1]!r}::DOUBLE) * y1 - {_A[2]!r}::DOUBLE * y2
      FROM y JOIN sig s ON s.subject = y.subject AND s.channel = y.channel AND s.sample = y.sample + 1)
    SELECT subject, channel, sample, round(y1, 4) + 0.0 AS value FROM y
    UNION ALL SELECT subject, channel, sample, round(value, 4) + 0.0 FROM sig WHERE sample = 0""".replace("np.float64", ""),
)
def iir_notch(spark, sf):
    return _long(fl.iir_notch(b.samples(spark, sf), FS, 12.0, b.CHUNK))


_UP, _DOWN = 2, 5
_POLY = fl.poly_taps(_UP, _DOWN)


@query(
    "resample_poly",
    f"""WITH {b.SIGNAL_SQL}, {_N}, h AS (SELECT i - {len(_POLY) // 2} AS k, w FROM (VALUES {_values(_POLY)}) AS v(i, w))
    SELECT subject, channel, (k + {_UP} * sig.sample) // {_DOWN} AS sample, round(sum(w * value), 4) + 0.0 AS value
    FROM sig JOIN n USING (subject, channel), h
    WHERE (k + {_UP} * sig.sample) % {_DOWN} = 0 AND k + {_UP} * sig.sample >= 0
      AND (k + {_UP} * sig.sample) // {_DOWN} < (n * {_UP} + {_DOWN} - 1) // {_DOWN} GROUP BY ALL""",
)
def resample_poly(spark, sf):
    return _long(fl.resample_poly(b.samples(spark, sf), _UP, _DOWN))


# Linear kernels are written out as matrices (response to each single sample) for SQL.


# One matrix per trial length, since the end of a recording cuts trials short.
_LENGTHS = range(1, b.TRIAL_SAMPLES + 1)


def _matrices(kernel) -> str:
    return ", ".join(
        f"({n}, {i}, {j}, {float(x)!r}::DOUBLE)"
        for n in _LENGTHS for i, row in enumerate(kernel(np.eye(n))) for j, x in enumerate(row)
    )


_FULL_SQL = """fe AS (SELECT subject, channel, trial, t, value, count(*) OVER (PARTITION BY subject, channel, trial) AS n FROM dep)"""


def _array_rows(df):
    return df.select("subject", "trial", "channel", F.posexplode("values").alias("t", "value")).withColumn(
        "value", R(F.col("value"), 4)
    )


@query(
    "resample",
    f"""WITH {b.SIGNAL_SQL}, {b.DENSE_EPOCHS_SQL}, {_FULL_SQL},
    m AS (SELECT * FROM (VALUES {_matrices(fl.fft_resample_kernel(FS, 40.0))}) AS v(n, i, j, w))
    SELECT subject, trial, channel, j AS t, round(sum(w * value), 4) + 0.0 AS value FROM fe JOIN m ON t = i AND fe.n = m.n GROUP BY ALL""",
)
def resample(spark, sf):
    rows = b.epoch_arrays(spark, sf)
    return _array_rows(rows.withColumn("values", fl.resample(F.col("values"), FS, 40.0)))


_BAND, _SMOOTH_MS = (10.0, 30.0), 20.0


@query(
    "extract_band",
    f"""WITH {b.SIGNAL_SQL}, {b.DENSE_EPOCHS_SQL}, {_FULL_SQL},
    m AS (SELECT * FROM (VALUES {_matrices(fl.band_kernel(*_BAND, FS))}) AS v(n, i, j, w)),
    g AS (SELECT * FROM (VALUES {_matrices(fl.smooth_kernel(_SMOOTH_MS / 1000 * FS))}) AS v(n, i, j, w)),
    p AS (SELECT subject, trial, channel, fe.n, j AS t, abs(sum(w * value)) AS value FROM fe JOIN m ON t = i AND fe.n = m.n GROUP BY ALL)
    SELECT subject, trial, channel, j AS t, round(sum(w * value), 4) + 0.0 AS value FROM p JOIN g ON t = i AND p.n = g.n GROUP BY ALL""",
)
def extract_band(spark, sf):
    return _array_rows(fl.extract_band(b.epoch_arrays(spark, sf), FS, _BAND, "abs", _SMOOTH_MS))


@query(
    "band_envelope",
    f"""WITH {b.SIGNAL_SQL}, {b.DENSE_EPOCHS_SQL}, {_FULL_SQL},
    re AS (SELECT * FROM (VALUES {_matrices(lambda x: fl.analytic_band(x, *_BAND, FS).real)}) AS v(n, i, j, w)),
    im AS (SELECT * FROM (VALUES {_matrices(lambda x: fl.analytic_band(x, *_BAND, FS).imag)}) AS v(n, i, j, w)),
    a AS (SELECT subject, trial, channel, re.j AS t, sum(re.w * value) AS x, sum(im.w * value) AS y
      FROM fe JOIN re ON t = re.i AND fe.n = re.n JOIN im ON im.n = re.n AND im.i = re.i AND im.j = re.j GROUP BY ALL)
    SELECT subject, trial, channel, t, round(sqrt(x * x + y * y), 4) + 0.0 AS value FROM a""",
)
def band_envelope(spark, sf):
    return _array_rows(fl.extract_envelope(b.epoch_arrays(spark, sf), FS, _BAND))


_FREQS = range(5, 45, 4)


def _wavelet_values(freqs, fs: float, count: int = 3) -> str:
    """Rows (freq, taper, offset, re, im), with tapers from the whole eigenproblem."""
    rows = []
    for f in freqs:
        n = max(3, int(f / 2 / f * fs) | 1)
        i = np.arange(n)
        off = i[1:] * (n - i[1:]) / 2.0
        diagonal = ((n - 1 - 2 * i) / 2.0) ** 2 * np.cos(4 * np.pi / n)
        _, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
        for j in range(count):
            wave = vectors[:, n - 1 - j] * np.exp(2j * np.pi * f * (i - n // 2) / fs)
            rows += [f"({f}, {j}, {k - n // 2}, {x.real!r}::DOUBLE, {x.imag!r}::DOUBLE)" for k, x in enumerate(wave.tolist())]
    return ", ".join(rows)


@query(
    "spectrogram",
    # power is a quadratic form of a trial, so sums over trials need the sums of products of its samples only
    f"""WITH {b.SIGNAL_SQL}, {b.DENSE_EPOCHS_SQL},
    k AS (SELECT * FROM (VALUES {_wavelet_values(_FREQS, FS)}) AS v(freq, taper, k, re, im) WHERE abs(k) < 25),
    w AS (SELECT freq, t, t - a.k AS t1, t - c.k AS t2, sum(a.re * c.re + a.im * c.im) / 3 AS w
      FROM k AS a JOIN k AS c USING (freq, taper), range(25) AS r(t)
      WHERE t - a.k BETWEEN 0 AND 24 AND t - c.k BETWEEN 0 AND 24 GROUP BY ALL),
    len AS (SELECT subject, channel, trial, label = 0 AS is_base, count(*) AS n FROM dep GROUP BY ALL),
    r AS (SELECT subject, channel, is_base, n, count(*) AS trials FROM len GROUP BY ALL),
    s AS (SELECT subject, channel, is_base, n, a.t AS t1, c.t AS t2, sum(a.value * c.value) AS s
      FROM dep AS a JOIN dep AS c USING (subject, channel, trial) JOIN len USING (subject, channel, trial) GROUP BY ALL),
    p AS (SELECT subject, channel, is_base, n, freq, t, sum(w * s) AS p FROM s JOIN w USING (t1, t2) WHERE t < n GROUP BY ALL),
    q AS (SELECT * FROM p JOIN r USING (subject, channel, is_base, n)),
    base AS (SELECT subject, channel, freq, sum(p) / sum(trials) AS m FROM q WHERE is_base GROUP BY ALL),
    mean AS (SELECT subject, channel, freq, t, sum(p) / sum(trials) AS m FROM q GROUP BY ALL)
    SELECT subject, channel, CAST(freq AS DOUBLE) AS freq, CAST(t AS INTEGER) AS t, round(mean.m / nullif(base.m, 0), 6) AS power
    FROM mean JOIN base USING (subject, channel, freq)""",
)
def spectrogram(spark, sf):
    rows = b.epoch_arrays(spark, sf)
    out = fl.spectrogram(rows, rows.filter("label = 0"), FS, _FREQS, pad_s=0.1)
    return out.withColumn("power", R(F.col("power")))


_SIGMA = 2.0
_GAUSS = fl.gaussian_weights(_SIGMA)


@query(
    "gauss_smooth",
    f"""WITH {b.SIGNAL_SQL}, {b.DENSE_EPOCHS_SQL}, n AS (SELECT subject, channel, trial, max(t) + 1 AS n FROM dep GROUP BY ALL),
    h AS (SELECT i - {len(_GAUSS) // 2} AS k, w FROM (VALUES {_values(_GAUSS)}) AS v(i, w)),
    s AS (SELECT subject, channel, trial, t AS sample FROM dep)
    SELECT s.subject, s.channel, s.trial, CAST(s.sample AS INTEGER) AS t, round(sum(w * x.value), 4) + 0.0 AS value
    FROM s JOIN n USING (subject, channel, trial), h JOIN dep x ON x.subject = s.subject AND x.channel = s.channel
      AND x.trial = s.trial AND x.t = {_MIRRORED} GROUP BY ALL""",
)
def gauss_smooth(spark, sf):
    rows = b.epoch_arrays(spark, sf)
    return _array_rows(rows.withColumn("values", fl.smooth(F.col("values"), _SIGMA)))


@query(
    "cue_align",
    f"""WITH {b.SIGNAL_SQL}, tr AS (SELECT event_id, event_id % 3 AS subject, event_id % 24 AS stimulus,
      greatest(CAST(trunc((event_id // 16 / 100.0::DOUBLE - 0.5) * 100) AS BIGINT), 0) AS lo,
      CAST(trunc((event_id // 16 / 100.0::DOUBLE + 0.7::DOUBLE) * 100) AS BIGINT) AS hi FROM events),
    st AS (SELECT 8 * subject + contact - 1 AS stimulus, sample AS i, value AS w,
      count(*) OVER (PARTITION BY subject, contact) AS n FROM sig WHERE sample < {b.CHUNK}),
    c AS (SELECT event_id, tr.subject, tr.stimulus, lo, n, sample - lo - i AS lag, sum(value * w) AS corr FROM tr
      JOIN sig ON sig.subject = tr.subject AND contact = 1 AND sample >= lo AND sample < hi
      JOIN st ON st.stimulus = tr.stimulus GROUP BY ALL)
    SELECT event_id, subject, stimulus, (lo + lag) / 100.0::DOUBLE AS stim_onset, (lo + lag) / 100.0::DOUBLE + n / 100.0::DOUBLE AS stim_offset
    FROM (SELECT event_id, subject, stimulus, lo, n, arg_max(lag, abs(corr)) AS lag FROM c GROUP BY ALL)""",
)
def cue_align(spark, sf):
    key = F.col("event_id")
    trials = b.table(spark, sf, "events").select(
        "event_id", F.pmod(key, F.lit(3)).alias("subject"), (key % 24).alias("stimulus"),
        (F.floor(key / 16) / F.lit(FS)).alias("onset"),
    )
    chunks = b.samples(spark, sf)
    contact = F.substring("channel", 2, 1).cast("long")
    stimuli = chunks.filter("chunk = 0").select((F.col("subject") * 8 + contact - 1).alias("stimulus"), F.col("values").alias("wave"))
    out = fl.align_cues(trials, chunks.filter("channel = 'E1'"), stimuli, FS, b.CHUNK)
    return out.select("event_id", "subject", "stimulus", "stim_onset", "stim_offset")


_TRACE = """tr AS (SELECT o_orderkey % 3 AS subject, o_orderkey // 3 AS sample, o_totalprice / 1000000
    + CASE WHEN o_orderkey // 3 BETWEEN 60 AND 139 THEN 20 ELSE 0 END
    + CASE WHEN o_orderkey // 3 % 450 BETWEEN 440 AND 446 THEN 10 - abs(o_orderkey // 3 % 450 - 443) ELSE 0 END AS value
    FROM orders)"""


def _trace(spark, sf):
    key = F.col("o_orderkey")
    sample = F.floor(key / 3)
    phase = F.pmod(sample, F.lit(450))
    return b.table(spark, sf, "orders").select(
        F.pmod(key, F.lit(3)).alias("subject"), sample.alias("sample"),
        (
            F.col("o_totalprice") / 1000000
            + F.when(sample.between(60, 139), 20).otherwise(0)
            + F.when(phase.between(440, 446), 10 - F.abs(phase - 443)).otherwise(0)
        ).alias("value"),
    )


@query(
    "trigger_candidates",
    f"""WITH {_TRACE}, q AS (SELECT subject, quantile_cont(value, 0.1) AS base, median(value) AS med FROM tr GROUP BY subject),
    l AS (SELECT subject, any_value(base) AS base, any_value(base) + 5 * 1.482602218505602 * median(abs(value - med)) AS thr
      FROM tr JOIN q USING (subject) GROUP BY subject),
    n AS (SELECT subject, sample, value, lag(value) OVER w AS p, lead(value) OVER w AS x FROM tr
      WINDOW w AS (PARTITION BY subject ORDER BY sample))
    SELECT subject, sample, round(value, 6) AS height FROM n JOIN l USING (subject) WHERE value >= thr AND p < value AND x < value""",
)
def trigger_candidates(spark, sf):
    out = tg.trigger_candidates(_trace(spark, sf), ["subject"])
    return out.withColumn("height", R(F.col("height")))


@query("trigger_onsets")
def trigger_onsets(spark, sf):
    return tg.trigger_onsets(_trace(spark, sf), ["subject"], FS)

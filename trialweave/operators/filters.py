"""Filters, resampling and spectral features on arrays of samples.

Kernels are numpy functions on a matrix (rows x samples); Arrow-batched UDFs feed them.
Filters on continuous recordings work chunk by chunk: each chunk is joined with the few
samples of its neighbours that the filter reaches, so no recording is ever held whole
and the result equals filtering the whole recording.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import check_band
from ..plans import cut_lineage, join_keys, join_measured


# --- array UDFs ----------------------------------------------------------------


def _by_length(series: pd.Series, fn: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """Apply a matrix kernel to arrays of a batch, grouped by length; NULL stays NULL."""
    out: list = [None] * len(series)
    groups: dict[int, list[int]] = {}
    for i, values in enumerate(series):
        if values is not None:
            groups.setdefault(len(values), []).append(i)
    for places in groups.values():
        result = fn(np.array([series.iloc[i] for i in places], dtype=float))
        for place, row in zip(places, result):
            out[place] = row
    return pd.Series(out, dtype=object)


def array_udf(kernel: Callable[[np.ndarray], np.ndarray]):
    """UDF ``array<double> -> array<double>`` from a kernel on equal-length rows."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return _by_length(values, kernel)

    return run


# --- kernels -------------------------------------------------------------------


def mirror(x: np.ndarray, before: int, after: int) -> np.ndarray:
    """Extend rows at both ends by reflection about the edge (edge sample repeated)."""
    return np.pad(x, ((0, 0), (before, after)), mode="symmetric")


def gaussian_weights(sigma: float) -> np.ndarray:
    """Gaussian weights cut at four sigma, summing to one."""
    radius = int(4.0 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def convolve_rows(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Valid part of the convolution of every row with ``taps`` (FFT)."""
    n = x.shape[1] + len(taps) - 1
    size = 1 << (n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[:, :n]
    return full[:, len(taps) - 1 : x.shape[1]]


def convolve_full(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Full convolution of two arrays (FFT)."""
    n = len(x) + len(y) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)[:n]


def smooth_kernel(sigma: float) -> Callable:
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    return lambda x: convolve_rows(mirror(x, radius, radius), weights)


def notch_length(fs: float, transition: float = 1.0) -> int:
    """Odd number of Hamming-windowed taps whose band edges are ``transition`` Hz wide."""
    return int(3.3 * fs / transition) | 1


def notch_taps(
    fs: float, line: float, width: float = 2.0, harmonics: int = 3, taps: int | None = None
) -> np.ndarray:
    """Zero-phase band-stop taps (Hamming-windowed) at the line frequency and multiples.

    Without ``taps`` their number follows from the rate, for band edges half as wide as the band.
    """
    taps = notch_length(fs, width / 2) if taps is None else taps
    if taps % 2 == 0:
        raise ValueError("taps must be odd")
    k = np.arange(taps) - taps // 2
    window = np.hamming(taps)
    h = np.zeros(taps)
    h[taps // 2] = 1.0
    for m in range(1, harmonics + 1):
        low, high = line * m - width / 2, min(line * m + width / 2, fs / 2)
        if low >= fs / 2:
            break
        band = (2 * high / fs) * np.sinc(2 * high / fs * k) - (2 * low / fs) * np.sinc(2 * low / fs * k)
        h -= band * window
    return h


def butterworth_gain(freqs: np.ndarray, low: float, high: float, fs: float, order: int = 4) -> np.ndarray:
    """Squared magnitude of a band-pass Butterworth filter (run forward and backward)."""

    def warp(f):
        return np.tan(np.pi * np.clip(f, 0, fs / 2 * 0.999999) / fs)

    w, lo, hi = warp(freqs), warp(low), warp(high)
    with np.errstate(divide="ignore"):
        ratio = (w * w - lo * hi) / (w * (hi - lo))
    return np.where(freqs == 0, 0.0, 1.0 / (1.0 + ratio ** (2 * order)))


def band_kernel(low: float, high: float, fs: float, order: int = 4) -> Callable:
    """Zero-phase band-pass of mirrored rows."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        padded = mirror(x, n, n)
        gain = butterworth_gain(np.fft.rfftfreq(padded.shape[1], 1 / fs), low, high, fs, order)
        return np.fft.irfft(np.fft.rfft(padded) * gain, padded.shape[1])[:, n : 2 * n]

    return run


def analytic_band(x: np.ndarray, low: float, high: float, fs: float) -> np.ndarray:
    """Complex analytic signal of mirrored rows, restricted to a band."""
    n = x.shape[1]
    padded = mirror(x, n, n)
    freqs = np.fft.fftfreq(padded.shape[1], 1 / fs)
    keep = (freqs >= low) & (freqs <= high)
    return np.fft.ifft(np.fft.fft(padded) * keep * 2.0)[:, n : 2 * n]


def envelope_kernel(low: float, high: float, fs: float) -> Callable:
    """Magnitude of the analytic signal restricted to a band."""
    return lambda x: np.abs(analytic_band(x, low, high, fs))


def fft_resample_kernel(fs: float, out_fs: float) -> Callable:
    """Fourier resampling of whole rows to another rate."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        m = max(1, int(round(n * out_fs / fs)))
        spectrum = np.fft.rfft(x)
        keep = min(n, m) // 2 + 1
        out = np.zeros((x.shape[0], m // 2 + 1), dtype=complex)
        out[:, :keep] = spectrum[:, :keep]
        if min(n, m) % 2 == 0 and n != m:
            out[:, keep - 1] *= 2.0 if m < n else 0.5
        return np.fft.irfft(out, m) * (m / n)

    return run


def _eigen_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eigenvalues of a symmetric tridiagonal matrix below each point: negative pivots of a Sturm sequence."""
    tiny = np.finfo(float).tiny ** 0.5
    squares = np.concatenate([[0.0], off * off])
    pivot, below = np.ones_like(at), np.zeros(at.shape, dtype=int)
    for d, s in zip(diagonal, squares):
        pivot = (d - at) - s / pivot
        pivot[np.abs(pivot) < tiny] = -tiny
        below += pivot < 0
    return below


def largest_eigen(diagonal: np.ndarray, off: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric tridiagonal matrix, and their vectors as rows.

    Values by Sturm counts at 63 points of every value's interval at a time, vectors by inverse iteration with a pivoted
    elimination, orthogonal to the vectors before. Work and memory grow with the length, not its square.
    """
    n = len(diagonal)
    reach = np.concatenate([np.abs(off), [0.0]]) + np.concatenate([[0.0], np.abs(off)])
    wanted = n - 1 - np.arange(count)  # eigenvalues below each wanted one
    low = np.full(count, (diagonal - reach).min())
    high = np.full(count, (diagonal + reach).max())
    scale = max(np.abs(low).max(), np.abs(high).max(), np.finfo(float).tiny)
    low, high = low - 1e-12 * scale, high + 1e-12 * scale
    share = np.arange(1, 64) / 64
    while (high - low).max() > 4 * np.finfo(float).eps * scale:
        points = low[:, None] + (high - low)[:, None] * share
        below = _eigen_below(diagonal, off, points.ravel()).reshape(points.shape) <= wanted[:, None]
        last = below.sum(axis=1)  # points up to the wanted eigenvalue
        edges = np.hstack([low[:, None], points, high[:, None]])
        new_low, new_high = edges[np.arange(count), last], edges[np.arange(count), last + 1]
        if (new_low == low).all() and (new_high == high).all():
            break
        low, high = new_low, new_high
    values = (low + high) / 2
    vectors = np.empty((count, n))
    rng = np.random.default_rng(n)
    for i, value in enumerate(values):
        solve = _shifted_solver(diagonal - value, off, np.finfo(float).eps * scale)
        x = rng.standard_normal(n)
        for _ in range(4):
            x = solve(x / np.linalg.norm(x))
            for _ in range(2):
                x -= vectors[:i].T @ (vectors[:i] @ x)
        vectors[i] = x / np.linalg.norm(x)
    return values, vectors


def _shifted_solver(diagonal: np.ndarray, off: np.ndarray, floor: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solver of a tridiagonal system, rows exchanged for the larger pivot, vanishing pivots set to ``floor``."""
    n = len(diagonal)
    main, above, second = diagonal.tolist(), [*off.tolist(), 0.0], [0.0] * n
    under = off.tolist()
    factors, swaps = [0.0] * (n - 1), [False] * (n - 1)
    for i in range(n - 1):
        if abs(under[i]) > abs(main[i]):
            swaps[i] = True
            row = main[i], above[i]
            main[i], above[i], second[i] = under[i], main[i + 1], above[i + 1]
            factor = row[0] / main[i]
            main[i + 1], above[i + 1] = row[1] - factor * above[i], -factor * second[i]
        else:
            if abs(main[i]) < floor:
                main[i] = floor
            factor = under[i] / main[i]
            main[i + 1] -= factor * above[i]
        factors[i] = factor
    if abs(main[-1]) < floor:
        main[-1] = floor

    def solve(right: np.ndarray) -> np.ndarray:
        x = right.tolist()
        for i in range(n - 1):
            if swaps[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factors[i] * x[i]
        x[-1] /= main[-1]
        if n > 1:
            x[-2] = (x[-2] - above[-2] * x[-1]) / main[-2]
        for i in range(n - 3, -1, -1):
            x[i] = (x[i] - above[i] * x[i + 1] - second[i] * x[i + 2]) / main[i]
        return np.asarray(x)

    return solve


@lru_cache(maxsize=256)
def slepian_tapers(n: int, half_bandwidth: float, count: int) -> np.ndarray:
    """Discrete prolate spheroidal tapers from their tridiagonal eigenproblem; solved once per length."""
    i = np.arange(n)
    diagonal = ((n - 1 - 2 * i) / 2.0) ** 2 * np.cos(2 * np.pi * half_bandwidth / n)
    off = i[1:] * (n - i[1:]) / 2.0
    _, tapers = largest_eigen(diagonal, off, count)
    signs = np.where(tapers.sum(axis=1) < 0, -1.0, 1.0)
    tapers = tapers * signs[:, None]
    tapers.flags.writeable = False  # shared by all callers
    return tapers


def spectrogram_kernel(freqs: Sequence[float], fs: float, cycles: Sequence[float], pad: int, tapers: int = 3):
    """Multitaper power per frequency and time; the result rows are flattened (freq, time)."""
    wavelets = []
    for f, c in zip(freqs, cycles):
        n = max(3, int(c / f * fs) | 1)
        carrier = np.exp(2j * np.pi * f * (np.arange(n) - n // 2) / fs)
        wavelets.append([taper * carrier for taper in slepian_tapers(n, 2.0, min(tapers, n - 1))])

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        padded = np.pad(x, ((0, 0), (pad, pad)))
        size = 1 << (padded.shape[1] + max(len(w[0]) for w in wavelets) - 1).bit_length()
        spectrum = np.fft.fft(padded, size)
        out = np.empty((x.shape[0], len(wavelets), n))
        for i, group in enumerate(wavelets):
            power = 0.0
            for w in group:
                start = pad + len(w) // 2
                z = np.fft.ifft(spectrum * np.fft.fft(w, size))[:, start : start + n]
                power = power + np.abs(z) ** 2
            out[:, i] = power / len(group)
        return out.reshape(x.shape[0], -1)

    return run


# --- epochs --------------------------------------------------------------------


def smooth(values: Column, sigma: float) -> Column:
    """Gaussian smoothing along time (sigma in samples), edges mirrored."""
    return array_udf(smooth_kernel(sigma))(values)


def resample(values: Column, fs: float, out_fs: float) -> Column:
    return array_udf(fft_resample_kernel(fs, out_fs))(values)


def extract_band(
    epochs: DataFrame, fs: float, band: tuple[float, float] = (300.0, 1000.0), power: str = "abs",
    smooth_ms: float = 50.0, order: int = 4,
) -> DataFrame:
    """Band power of epochs: band-pass, rectify (``abs`` or ``square``), smooth."""
    if power not in ("abs", "square"):
        raise ValueError(f"power must be 'abs' or 'square', got {power!r}")
    low, high = check_band(*band, fs)
    passband = band_kernel(low, high, fs, order)
    rectifier = np.abs if power == "abs" else np.square
    smoother = smooth_kernel(smooth_ms / 1000.0 * fs) if smooth_ms > 0 else None

    def kernel(x: np.ndarray) -> np.ndarray:
        y = rectifier(passband(x))
        return y if smoother is None else smoother(y)

    return epochs.withColumn("values", array_udf(kernel)("values"))


def extract_envelope(epochs: DataFrame, fs: float, band: tuple[float, float] = (70.0, 150.0)) -> DataFrame:
    """Band envelope of epochs by the analytic signal."""
    low, high = check_band(*band, fs)
    return epochs.withColumn("values", array_udf(envelope_kernel(low, high, fs))("values"))


# feature extractors by name, each ``(epochs, fs, **options) -> epochs``
EXTRACTORS: dict[str, Callable[..., DataFrame]] = {"band": extract_band, "envelope": extract_envelope}


def register_extractor(name: str, fn: Callable[..., DataFrame]) -> None:
    EXTRACTORS[name] = fn


def spectrogram(
    epochs: DataFrame, baseline: DataFrame, fs: float, freqs: Sequence[float], cycles: Sequence[float] | None = None,
    pad_s: float = 0.5, keys: Sequence[str] = ("subject", "channel"),
) -> DataFrame:
    """Trial-averaged multitaper power relative to the baseline mean per frequency.

    Result: keys, ``freq``, ``t``, ``power``.
    """
    freqs = [float(f) for f in freqs]
    cycles = [f / 2 for f in freqs] if cycles is None else list(cycles)
    udf = array_udf(spectrogram_kernel(freqs, fs, cycles, int(round(pad_s * fs))))
    grid = F.array(*[F.lit(f) for f in freqs])

    def summed(rows: DataFrame) -> DataFrame:
        """Sums over the trials of a length, added up as vectors in the tasks, then one row per value."""
        powers = rows.filter(F.col("values").isNotNull()).select(
            *keys, F.size("values").alias("__n"), array_to_vector(udf("values")).alias("__p")
        )
        sums = powers.groupBy(*keys, "__n").agg(
            vector_to_array(Summarizer.sum(F.col("__p"))).alias("__sum"), F.count(F.lit(1)).alias("__rows")
        )
        spread = sums.select(*keys, "__n", "__rows", F.posexplode("__sum").alias("__i", "__sum"))
        return spread.select(
            *keys, F.get(grid, F.floor(F.col("__i") / F.col("__n")).cast("int")).alias("freq"),
            F.pmod("__i", "__n").alias("t"), "__sum", "__rows",
        )

    mean = F.sum("__sum") / F.sum("__rows")
    base = summed(baseline).groupBy(*keys, "freq").agg(mean.alias("__base"))
    averaged = summed(epochs).groupBy(*keys, "freq", "t").agg(mean.alias("power"))
    joined = join_keys(averaged, base, [*keys, "freq"])
    return joined.withColumn("power", F.col("power") / F.nullif(F.col("__base"), F.lit(0.0))).drop("__base")


# --- continuous recordings -----------------------------------------------------


def with_borders(
    chunks: DataFrame, keys: Sequence[str], before: int, after: int, chunk: int | None = None
) -> DataFrame:
    """Add ``left`` / ``right``: the ``before`` / ``after`` samples next to a chunk.

    NULL at the ends of a recording. Two equi-joins on (keys, chunk); a reach beyond one
    chunk of ``chunk`` samples takes copies of several neighbours, put together per chunk.
    Chunks that do not meet their neighbour are an error, and so is a chunk without a neighbour that is neither the first
    nor the last of its recording: a gap would shift all samples.
    """
    by = [*keys, "chunk"]
    stop = F.col("start_sample") + F.size("values")

    def side(reach: int, step: int, name: str) -> DataFrame:
        count = 1 if chunk is None else -(-reach // chunk)
        parts = chunks
        if count > 1:
            away = F.explode(F.sequence(F.lit(1), F.lit(count))).alias("__away")
            parts = chunks.select("*", away)
        else:
            parts = chunks.withColumn("__away", F.lit(1))
        edge = stop if step > 0 else F.col("start_sample")
        # what is left of the reach at this distance
        room = F.lit(reach) - (F.col("__away") - 1) * F.lit(chunk or 0)
        take = F.least(F.size("values"), room)
        piece = F.slice("values", -take, take) if step > 0 else F.slice("values", F.lit(1), take)
        parts = parts.select(
            *keys, (F.col("chunk") + step * F.col("__away")).alias("chunk"), "__away", piece.alias("__piece"), edge.alias("__edge")
        )
        if count > 1:
            order = F.array_sort(F.collect_list(F.struct((-step * F.col("__away")).alias("p"), "__piece", "__edge")))
            parts = parts.groupBy(*by).agg(order.alias("__parts"))
            nearest = F.element_at("__parts", -1 if step > 0 else 1)
            parts = parts.select(
                *by, F.flatten(F.transform("__parts", lambda x: x["__piece"])).alias(name), nearest["__edge"].alias("__edge")
            )
        else:
            parts = parts.select(*by, F.col("__piece").alias(name), "__edge")
        own = F.col("start_sample") if step > 0 else stop
        joined = chunks.select(*by, own.alias("__own")).join(parts, by)
        gap = F.raise_error(F.lit("chunks of a recording do not meet"))
        return joined.select(*by, F.when(F.col("__own") == F.col("__edge"), F.col(name)).otherwise(gap).alias(name))

    out = chunks
    for name, reach, step in (("left", before, 1), ("right", after, -1)):
        if reach:
            out = out.join(side(reach, step, name), by, "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("array<double>"))
    ends = chunks.groupBy(*keys).agg(F.min("chunk").alias("__left"), F.max("chunk").alias("__right"))
    out = join_measured(out, ends, keys)
    lost = F.raise_error(F.lit("a chunk of a recording is missing"))
    for name, reach in (("left", before), ("right", after)):
        if reach:
            out = out.withColumn(name, F.when(F.col(name).isNull() & (F.col("chunk") != F.col(f"__{name}")), lost).otherwise(F.col(name)))
    return out.drop("__left", "__right")


def _border_udf(fn: Callable[[np.ndarray, np.ndarray | None, np.ndarray | None], np.ndarray]):
    @F.pandas_udf("array<double>")
    def run(values: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([fn(v, l, r) for v, l, r in zip(values, left, right)], dtype=object)

    return run


def notch(
    chunks: DataFrame, fs: float, line: float = 60.0, width: float = 2.0, taps: int | None = None,
    keys: Sequence[str] = ("subject", "channel"), chunk: int | None = None,
) -> DataFrame:
    """Remove the line frequency and its first harmonics, zero phase.

    The filter reaches ``taps // 2`` samples to both sides; pass ``chunk``, the length of all
    chunks but the last, where that exceeds a chunk. Recordings are mirrored at their ends.
    """
    h = notch_taps(fs, line, width, taps=taps)
    half = len(h) // 2

    def run(values, left, right):
        x = np.asarray(values, dtype=float)
        own = len(x)
        parts = [p for p in (left, x, right) if p is not None and len(p)]
        row = np.concatenate(parts)[None, :]
        have_left = 0 if left is None else len(left)
        have_right = 0 if right is None else len(right)
        row = mirror(row, half - have_left, half - have_right)
        return convolve_rows(row, h)[0][:own]

    bordered = with_borders(chunks, keys, half, half, chunk)
    return bordered.withColumn("values", _border_udf(run)("values", "left", "right")).drop("left", "right")


def poly_taps(up: int, down: int) -> np.ndarray:
    """Kaiser-windowed low-pass at the lower of both Nyquist limits, gain ``up``."""
    half = 10 * max(up, down)
    cutoff = 1.0 / max(up, down)
    h = cutoff * np.sinc(cutoff * np.arange(-half, half + 1)) * np.kaiser(2 * half + 1, 5.0)
    return h * (up / h.sum())


def resample_poly(
    chunks: DataFrame, up: int, down: int, keys: Sequence[str] = ("subject", "channel")
) -> DataFrame:
    """Rational resampling by ``up / down`` with a Kaiser-windowed low-pass, zero phase.

    Each chunk yields the output samples whose time falls into it; ``start_sample`` then
    counts output samples.
    """
    common = math.gcd(up, down)
    up, down = up // common, down // common
    if up == down:
        return chunks
    h = poly_taps(up, down)
    half = len(h) // 2
    reach = half // up + 1

    @F.pandas_udf("array<double>")
    def run(values: pd.Series, left: pd.Series, right: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for v, l, r, s in zip(values, left, right, start):
            before = np.zeros(0) if l is None else np.asarray(l)
            after = np.zeros(0) if r is None else np.asarray(r)
            x = np.concatenate([before, v, after])
            first, stop = -(-s * up // down), -(-(s + len(v)) * up // down)
            stuffed = np.zeros(len(x) * up)
            stuffed[::up] = x
            y = np.convolve(stuffed, h)
            at = np.arange(first, stop) * down - (s - len(before)) * up + half
            out.append(y[at])
        return pd.Series(out, dtype=object)

    bordered = with_borders(chunks, keys, reach, reach)
    new_start = F.ceil(F.col("start_sample") * F.lit(up) / F.lit(down))
    return (
        bordered.withColumn("values", run("values", "left", "right", "start_sample"))
        .withColumn("start_sample", new_start)
        .drop("left", "right")
    )


def iir_notch_coefficients(fs: float, freq: float, bandwidth: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Second-order notch: feed-forward ``b`` and feedback ``a`` (``a[0]`` = 1)."""
    d = math.exp(-math.pi * bandwidth / fs)
    turn = math.cos(2.0 * math.pi * freq / fs)
    gain = (1.0 + d * d) / 2.0
    b = gain * np.array([1.0, -2.0 * turn, 1.0])
    a = np.array([1.0, -(1.0 + d * d) * turn, d * d])
    return b, a


def iir_notch(
    chunks: DataFrame, fs: float, freq: float, chunk: int, bandwidth: float = 10.0, major_version: int = 2,
    keys: Sequence[str] = ("subject", "channel"),
) -> DataFrame:
    """Recursive acquisition notch over whole recordings, without running through them in one task.

    The filter is linear, so its output in a chunk is the output from rest plus the
    response to the two outputs before the chunk. Every chunk is first filtered from rest.
    The outputs before a chunk then follow from the rest outputs at the ends of all chunks
    before it, each multiplied by a power of a fixed 2x2 matrix. These sums are a scan over
    chunks: in round k a chunk takes over the sum of the chunk 2**k before, so the number of
    rounds is the logarithm of the number of chunks (fewer if a power is zero). No filtering if ``freq`` is 0 or the
    recording's major version is 3 or higher. ``chunk`` is the length of all chunks but the
    last. The first two outputs of a recording equal its input.
    """
    if freq == 0 or major_version >= 3:
        return chunks
    b, a = iir_notch_coefficients(fs, freq, bandwidth)

    # responses to (y[-1], y[-2]) = (1, 0) and (0, 1) with no input
    answers = np.zeros((2, chunk))
    for j, state in enumerate(((1.0, 0.0), (0.0, 1.0))):
        y1, y2 = state
        for i in range(chunk):
            y = -a[1] * y1 - a[2] * y2
            answers[j, i] = y
            y1, y2 = y, y1
    # maps the state before a chunk to the state after it
    step = np.array([[answers[0, -1], answers[1, -1]], [answers[0, -2], answers[1, -2]]])
    def from_rest(x: np.ndarray, x1: np.ndarray, x2: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows filtered together, sample by sample; ``first`` marks recording starts."""
        out = np.zeros_like(x)
        y1 = np.zeros(len(x))
        y2 = np.zeros(len(x))
        for i in range(x.shape[1]):
            y = b[0] * x[:, i] + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
            if i < 2:
                y = np.where(first, x[:, i], y)
            out[:, i] = y
            x2, x1, y2, y1 = x1, x[:, i], y1, y
        return out

    @F.pandas_udf("array<double>")
    def rest(values: pd.Series, left: pd.Series) -> pd.Series:
        first = np.array([l is None for l in left])
        before = np.array([(0.0, 0.0) if l is None else (l[-1], l[-2]) for l in left]).reshape(-1, 2)
        out: list = [None] * len(values)
        groups: dict[int, list[int]] = {}
        for i, v in enumerate(values):
            groups.setdefault(len(v), []).append(i)
        for places in groups.values():
            x = np.array([values.iloc[i] for i in places], dtype=float)
            y = from_rest(x, before[places, 0], before[places, 1], first[places])
            for place, row in zip(places, y):
                out[place] = row
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<double>")
    def settle(values: pd.Series, y1: pd.Series, y2: pd.Series) -> pd.Series:
        return pd.Series(
            [
                v + p * answers[0, : len(v)] + q * answers[1, : len(v)]
                for v, p, q in zip(values, y1, y2)
            ],
            dtype=object,
        )

    by = [*keys, "chunk"]
    rested = with_borders(chunks, keys, 2, 0).withColumn("values", rest("values", "left")).drop("left", "right")
    ends = rested.select(*by, F.element_at("values", -1).alias("y1"), F.get("values", F.size("values") - 2).alias("y2"))
    states = cut_lineage(ends.filter("y2 IS NOT NULL"))  # a lone last sample has no successor
    number = states.agg((F.max("chunk") - F.min("chunk")).alias("n")).first().n or 0
    reach, power = 1, step
    while reach <= number and power.any():
        ahead = states.select(
            *keys, (F.col("chunk") + reach).alias("chunk"),
            (F.lit(float(power[0, 0])) * F.col("y1") + F.lit(float(power[0, 1])) * F.col("y2")).alias("__y1"),
            (F.lit(float(power[1, 0])) * F.col("y1") + F.lit(float(power[1, 1])) * F.col("y2")).alias("__y2"),
        )
        states = cut_lineage(
            states.join(ahead, by, "left").select(
                *by, *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0.0))).alias(c) for c in ("y1", "y2")]
            )
        )
        reach, power = 2 * reach, power @ power
    # the state after a chunk is the one before the next
    states = states.withColumn("chunk", F.col("chunk") + 1)
    zero = F.lit(0.0)
    return (
        rested.join(states, by, "left")
        .withColumn("values", settle("values", F.coalesce("y1", zero), F.coalesce("y2", zero)))
        .drop("y1", "y2")
    )


# --- cue alignment and trigger detection ---------------------------------------


def align_cues(
    trials: DataFrame, mic: DataFrame, stimuli: DataFrame, fs: float, chunk: int,
    before: float = 0.5, after: float = 0.7,
) -> DataFrame:
    """Exact stimulus onset per trial: the lag of the largest cross-correlation magnitude.

    ``trials``: subject, trial columns, ``onset``, ``stimulus``; ``mic``: chunked
    microphone recording; ``stimuli``: ``stimulus``, ``wave`` at the same rate.
    Adds ``stim_onset`` and ``stim_offset``.
    """
    from .epochs import cut_windows

    rate = F.lit(float(fs))
    windows = trials.withColumn(
        "__lo", F.greatest(((F.col("onset") - F.lit(before)) * rate).cast("long"), F.lit(0))
    ).withColumn("__hi", ((F.col("onset") + F.lit(after)) * rate).cast("long"))
    cut = cut_windows(windows.filter("__hi > __lo"), mic, chunk, "__lo", "__hi").filter(F.size("values") > 0)

    @F.pandas_udf("long")
    def best_lag(window: pd.Series, wave: pd.Series) -> pd.Series:
        return pd.Series(
            [
                int(np.argmax(np.abs(convolve_full(np.asarray(w, float), np.asarray(s, float)[::-1])))) - (len(s) - 1)
                for w, s in zip(window, wave)
            ]
        )

    joined = join_measured(cut, stimuli.select("stimulus", "wave"), ["stimulus"])
    onset = (F.col("__lo") + best_lag("values", "wave")) / rate
    return (
        joined.withColumn("stim_onset", onset)
        .withColumn("stim_offset", F.col("stim_onset") + F.size("wave") / rate)
        .drop("__lo", "__hi", "values", "wave")
    )

"""Numeric column functions: units, scaling of raw words, time and windows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import codes
from .text import literal_map


def seconds_between(stamp: Column | str, epoch: str) -> Column:
    """Seconds from ``epoch`` (text, no zone) to a zone-less timestamp, as DOUBLE."""
    column = F.col(stamp) if isinstance(stamp, str) else stamp
    span = column - F.lit(epoch).cast("timestamp_ntz")
    return span.cast("interval second").cast("decimal(20,6)").cast("double")


def onset_sample(onset: Column, fs: Column | float) -> Column:
    """Sample index of an onset in seconds, truncated toward zero."""
    rate = fs if isinstance(fs, Column) else F.lit(float(fs))
    return (onset * rate).cast("long")


def to_volts(value: Column, unit: Column) -> Column:
    """Value in the named unit converted to volts; another unit is an error."""
    factor = F.try_element_at(literal_map(codes.VOLTS_PER_UNIT), unit)
    return value * F.coalesce(
        factor, F.raise_error(F.concat(F.lit("unit not supported: "), unit)).cast("double")
    )


def _scale(raw: Column, rule: tuple[float, int]) -> Column:
    multiplier, offset = rule
    return (raw - F.lit(offset)) * F.lit(multiplier)


def scale_analog(raw: Column, kind: Column, board_mode: Column) -> Column:
    """Raw 16-bit word to physical units, by signal kind and ADC board mode."""
    adc = F.when(F.lit(False), F.lit(None).cast("double"))
    for mode, rule in codes.ADC_SCALE_BY_MODE.items():
        adc = adc.when(board_mode == mode, _scale(raw, rule))
    adc = adc.otherwise(_scale(raw, codes.ADC_SCALE_OTHER))
    return (
        F.when(kind == "amplifier", _scale(raw, codes.AMPLIFIER_SCALE))
        .when(kind == "aux", _scale(raw, codes.AUX_SCALE))
        .when(kind == "supply", _scale(raw, codes.SUPPLY_SCALE))
        .when(kind == "temperature", _scale(raw, codes.TEMPERATURE_SCALE))
        .when(kind == "adc", adc)
    )


def digital_bit(word: Column, bit: Column) -> Column:
    """Whether bit ``bit`` of a 16-bit word is set."""
    return F.getbit(word.cast("int"), bit.cast("int")) == 1


def window_time(index: Column, n: Column | int, start: float, stop: float) -> Column:
    """Time of point ``index`` on ``n`` evenly spaced points from start to stop."""
    count = n if isinstance(n, Column) else F.lit(n)
    step = (F.lit(float(stop)) - F.lit(float(start))) / (count - 1)
    return F.when(index == count - 1, F.lit(float(stop))).otherwise(
        index * step + F.lit(float(start))
    )


def in_window(time: Column, window: tuple[float, float]) -> Column:
    """Both ends included."""
    return (time >= F.lit(float(window[0]))) & (time <= F.lit(float(window[1])))


def is_close(a: Column, b: Column) -> Column:
    """Relative tolerance 1e-5 of ``b`` plus absolute tolerance 1e-8."""
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def phonemes_per_trial(task: Column) -> Column:
    """Phonemes per trial of a task, with the default for other tasks."""
    return F.coalesce(
        F.try_element_at(literal_map(codes.PHONEMES_PER_TRIAL), task),
        F.lit(codes.DEFAULT_PHONEMES_PER_TRIAL),
    )


def check_band(low: float, high: float, fs: float) -> tuple[float, float]:
    """Validate a frequency band; a band that ends at the Nyquist limit ends 0.01 Hz below."""
    if low >= high:
        raise ValueError(f"band needs low < high, got ({low}, {high})")
    if low <= 0:
        raise ValueError(f"band must be positive, got ({low}, {high})")
    if abs(fs - 2 * high) <= 1e-8 + 1e-5 * abs(2 * high):
        high = high - 0.01
    return low, high


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, with negative zero made zero (for reports and comparisons)."""
    return F.round(value, digits) + F.lit(0.0)


def hashed_normal(seed: int, *keys: Column | str) -> Column:
    """Standard normal noise as a function of ``keys`` (same value whenever a task re-runs)."""

    def uniform(part: int) -> Column:
        bits = F.pmod(F.xxhash64(F.lit(seed), F.lit(part), *keys), F.lit(1 << 52))
        return (bits + F.lit(0.5)) / F.lit(float(1 << 52))

    return F.sqrt(F.lit(-2.0) * F.log(uniform(0))) * F.cos(F.lit(2.0) * F.pi() * uniform(1))

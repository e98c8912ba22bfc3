"""Waveform array expressions. A waveform is ``array<array<float>>``, time-major
(``samples[t][component]``).

Crop, pad and the time mask are one no-lambda expression (``slice`` + ``concat`` +
``array_repeat``), evaluated right after the scan and before any shuffle, so the wide column
only ever travels at its final length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quakeframe.schema import LAYER_EPS, PEAK_EPS

N_COMPONENTS = 3


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_int(v) -> Column:
    return v if isinstance(v, Column) else F.lit(int(v))


def zero_samples(n) -> Column:
    """``n`` all-zero samples (an empty array when n <= 0)."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), N_COMPONENTS)
    return F.array_repeat(zero, _lit_int(n))


def fit_waveform(w, length, cutoff=None) -> Column:
    """C1 + C2 + C6: crop to ``length`` samples, zero-pad short traces to ``length``, and zero
    every sample from index ``cutoff`` on (when given). Negative cut-offs blank everything;
    cut-offs past the end change nothing."""
    w = _col(w)
    length = _lit_int(length)
    m = F.least(F.size(w), length)
    if cutoff is not None:
        m = F.least(m, _lit_int(cutoff))
    m = F.greatest(m, F.lit(0))
    return F.concat(F.slice(w, 1, m), zero_samples(length - m))


def stored_waveform(w, length) -> Column:
    """The fitted waveform, all zero where none is stored."""
    return F.coalesce(fit_waveform(w, length), zero_samples(length))


def stored_position(w, columns) -> Column:
    """The position as an array, all zero (a blanked station) where no waveform is stored."""
    pos = F.array(*[F.col(c).cast("double") for c in columns])
    return F.when(_col(w).isNull(), F.array_repeat(F.lit(0.0), len(columns))).otherwise(pos)


FLAT = ("_flat", "_width", "_odd")  # columns of a waveform that travels as one array of values


def flat_waveform(w) -> list[Column]:
    """A waveform as one array of values and the width of its samples: a fifth to a third shorter in a shuffle
    than an array per sample. One that is not rectangular stays as it is, in a column of its own."""
    w = _col(w)
    width = F.coalesce(F.size(F.get(w, F.lit(0))), F.lit(1))
    even = (width > 0) & F.forall(w, lambda s: s.isNotNull() & (F.size(s) == width))
    return [F.when(even, F.flatten(w)).alias("_flat"), F.when(even, width).alias("_width"), F.when(~even, w).alias("_odd")]


def whole_waveform() -> Column:
    """The waveform of the ``FLAT`` columns."""
    flat, width = F.col("_flat"), F.col("_width")
    last = (F.size(flat) / width).cast("int") - 1
    value = lambda i, j: F.get(flat, i * width + j)
    steps = F.sequence(F.lit(0), last)
    three = F.transform(steps, lambda i: F.array(value(i, F.lit(0)), value(i, F.lit(1)), value(i, F.lit(2))))
    other = F.transform(steps, lambda i: F.transform(F.sequence(F.lit(0), width - 1), lambda j: value(i, j)))
    rows = F.when(width == N_COMPONENTS, three).otherwise(other)
    return F.coalesce(F.col("_odd"), F.when(last >= 0, rows).when(last < 0, F.slice(F.array(flat), 1, 0)))


def crop(w, length) -> Column:
    """The first ``length`` samples."""
    return F.slice(_col(w), 1, _lit_int(length))


def blank_if(w, cond, length) -> Column:
    """C7 on the waveform: an all-zero trace of ``length`` samples where ``cond`` holds."""
    return F.when(cond, zero_samples(length)).otherwise(_col(w))


def peak_abs(w) -> Column:
    """A5: largest absolute amplitude over time and components (NaN propagates; empty -> NULL)."""
    flat = F.flatten(_col(w))
    return F.greatest(F.array_max(flat), -F.array_min(flat)).cast("double")


def log_peak_scale(peak) -> Column:
    """``ln(peak + 1e-8) / 100`` plus the two layer offsets."""
    return F.log(_col(peak) + F.lit(PEAK_EPS)) / 100 + F.lit(2 * LAYER_EPS)


def normalise(w, peak) -> Column:
    """``w / (peak + 1e-8)`` plus the two layer offsets, per sample (double precision)."""
    den = _col(peak) + F.lit(PEAK_EPS)
    return F.transform(_col(w), lambda s: F.transform(
        s, lambda x: x.cast("double") / den + F.lit(2 * LAYER_EPS)))


def nonzero_samples(w) -> Column:
    """Number of samples with any non-zero component (for reports)."""
    return F.size(F.filter(_col(w), lambda s: F.exists(s, lambda x: x != 0)))

"""Trace-level selection and balancing (row-local expressions, no shuffles).

Over-sampling is a bounded ``explode``: the number of extra copies is a function of one
row's magnitude or label, so no row fans out without bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.functions.portable import gt, hash_uniform, is_number, lt
from quakeframe.schema import (LOG10_DOWNSAMPLE_BELOW, LOG10_OVERSAMPLE_ABOVE, TRACE_COPY_BASE,
                               TRACE_COPY_EXP)


def explode_event_groups(groups: DataFrame, id_col: str, array_cols: list[str], index_col: str = "trace_idx",
                         traces_col: str | None = None, label_key: str | None = None) -> DataFrame:
    """One row per trace from per-event parallel arrays (an HDF5-style event group).

    ``arrays_zip`` keeps positions aligned and ``posexplode`` numbers the traces from 0 in
    stored order. ``traces_col`` names the array that has one element per trace: the others are
    cut to its length, or NULL-filled where shorter or absent, and an event without it
    contributes nothing (D18). Without ``traces_col`` the longest array counts. ``label_key``
    adds the arrays ``{label_key}`` and ``{label_key}_time`` as ``label`` and ``label_time``."""
    names = {c: c for c in array_cols}
    if label_key:
        names |= {"label": label_key, "label_time": f"{label_key}_time"}
    arrays = [F.coalesce(F.col(src), F.array().cast(groups.schema[src].dataType)) for src in names.values()]
    if traces_col:
        n = F.size(traces_col)
        groups = groups.filter(F.col(traces_col).isNotNull())
        # Whatever the others' lengths, the zipped array is as long as the traces.
        arrays = [F.slice(a, 1, n) for a in arrays] + [F.transform(F.col(traces_col), lambda x: F.lit(True))]
        names = {**names, "_has": None}
    zipped = F.arrays_zip(*[a.alias(name) for a, name in zip(arrays, names)])
    out = groups.select(F.col(id_col).alias("eq_id"), F.posexplode(zipped).alias(index_col, "_t"))
    return out.select("eq_id", F.col(index_col).cast("int").alias(index_col), *[F.col("_t")[c].alias(c) for c in names if c != "_has"])


def decimate_picks(traces: DataFrame, decimate: int = 1, pick_col: str = "p_pick") -> DataFrame:
    """``p //= decimate`` (floor division, as for non-negative NumPy ints)."""
    if decimate == 1:
        return traces
    return traces.withColumn(pick_col, F.floor(F.col(pick_col) / decimate).cast("int"))


def valid_traces(traces: DataFrame, label: str = "pga") -> DataFrame:
    """drop traces whose label is NaN or NULL; the trace key (0, 0) is a real trace."""
    return traces.filter(is_number(label))


def downsample_small(traces: DataFrame, label: str = "pga", threshold: float = LOG10_DOWNSAMPLE_BELOW,
                     drop_fraction: float = 0.5, seed: str = "0") -> DataFrame:
    """each trace with ``label < threshold`` is dropped with probability ``drop_fraction``.

    The draw is a hash of the trace key, so the kept set is the same on every run,
    partitioning and retry.
    """
    u = hash_uniform("eq_id", "trace_idx", salt=f"downsample|{seed}")
    return traces.filter(~(lt(label, threshold) & (u < drop_fraction)))


def events_with_traces(events: DataFrame, traces: DataFrame) -> DataFrame:
    """Events that still have at least one (valid) trace; a semi join on ``eq_id`` only.

    The trace side is reduced to distinct ids first (map-side de-duplication), so a hot event
    ships one key per map task, not its traces."""
    return events.join(traces.select("eq_id").distinct(), "eq_id", "left_semi")


def event_copy_count(magnitude, oversample: float) -> "F.Column":
    """``int(oversample ** (magnitude - 1) - 1)``, truncated toward zero, never negative."""
    n = (F.pow(F.lit(float(oversample)), magnitude - 1) - 1).cast("int")
    return F.greatest(n, F.lit(0))


def oversample_events(events: DataFrame, oversample: float = 1.0, oversample_mag: float = 4.0) -> DataFrame:
    """Add ``event_copy`` 0..n; events at or above ``oversample_mag`` get n extra copies.

    Only when ``oversample > 1``. ``sequence`` is guarded so that n <= 0 yields just copy 0
    (``sequence(0, -1)`` would count down, D12).
    """
    if oversample <= 1:
        return events.withColumn("event_copy", F.lit(0))
    n = F.when(F.col("magnitude") >= oversample_mag, event_copy_count(F.col("magnitude"), oversample)) \
        .otherwise(F.lit(0))
    n = F.when(is_number("magnitude"), n).otherwise(F.lit(0))
    return events.withColumn("event_copy", F.explode(F.sequence(F.lit(0), n)))


def trace_copy_count(label) -> "F.Column":
    """``round_half_even(4.5 ** (1.5 ** label) + 1)`` extra copies."""
    return F.bround(F.pow(F.lit(TRACE_COPY_BASE), F.pow(F.lit(TRACE_COPY_EXP), label)) + 1, 0).cast("int")


def oversample_traces(traces: DataFrame, label: str = "pga",
                      threshold: float = LOG10_OVERSAMPLE_ABOVE) -> DataFrame:
    """Strong-motion traces (``label > threshold``) get extra copies; ``trace_copy`` 0 is
    the original. Copies carry the key, pick and every other column of their trace."""
    n = F.when(gt(label, threshold), trace_copy_count(F.col(label))).otherwise(F.lit(0))
    return traces.withColumn("trace_copy", F.explode(F.sequence(F.lit(0), n)))

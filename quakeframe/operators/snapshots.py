"""Replay: an event's stations cut at several horizons and assembled into JSON-ready
snapshots (S5, T1, J9, ST5, C3).

Each horizon is computed from the original traces (never from a previous cut; D17).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions.waveform import crop, stored_position, stored_waveform, zero_samples
from quakeframe.operators.masking import apply_cutoff, mask_members, with_pick0
from quakeframe.operators.samples import hydrate_inputs
from quakeframe.schema import LADDER_SECS, MAX_STATIONS
from quakeframe.session import pinned


def event_waveforms(waveforms: DataFrame, event_ids: DataFrame, length: int) -> DataFrame:
    """The cropped waveforms of the given events. Spark moves the semi join below the joins that
    build the waveforms, so that those of other events are neither built nor shuffled."""
    w = waveforms.join(event_ids.select("eq_id"), "eq_id", "left_semi")
    return w.select("eq_id", "trace_idx", crop("samples", length).alias("waveform"))


def event_traces(event_ids: DataFrame, traces: DataFrame, waveforms: DataFrame, length: int) -> DataFrame:
    """S5 + C1: the traces of the given events with waveforms cropped to ``length`` samples.

    The crop runs right after the waveform scan, before the join shuffle."""
    t = traces.join(event_ids.select("eq_id"), "eq_id", "left_semi")
    w = event_waveforms(waveforms, event_ids, length)
    return t.join(w, ["eq_id", "trace_idx"], "left")  # without a stored waveform: NULL


def top_stations(traces: DataFrame, n: int = MAX_STATIONS, order: str = "stored") -> DataFrame:
    """The first ``n`` stations of every event, in stored order (trace index) or by pick.

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before the shuffle, so a
    hot event ships at most ``n`` rows per map task."""
    if order == "stored":
        keys = [F.col("trace_idx")]
    else:
        keys = [F.col("p_pick").asc_nulls_last(), F.col("trace_idx")]
    w = Window.partitionBy("eq_id").orderBy(*keys)
    # Filter on the raw row_number so the optimizer inserts the partial group limit.
    return (traces.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= int(n))
            .withColumn("slot", (F.col("_rn") - 1).cast("int")).drop("_rn"))


def cutoff_ladder(rows: DataFrame, secs=None) -> DataFrame:
    """Every station row once per horizon (a bounded ``explode`` of a literal list)."""
    secs = list(secs or LADDER_SECS)
    return rows.withColumn("mask_sec", F.explode(F.array(*[F.lit(int(s)) for s in secs])))


def snapshot_ladder(traces: DataFrame, waveforms: DataFrame, event_ids: DataFrame, secs=None,
                    rate: int = 200, length: int = 3000, max_station_num: int = MAX_STATIONS,
                    order: str = "stored") -> DataFrame:
    """ST5: long-form snapshots, one row per (event, horizon, station slot).

    The top-k runs on the narrow trace rows; only the kept stations fetch their waveforms."""
    t = traces.join(event_ids.select("eq_id"), "eq_id", "left_semi")
    top = with_pick0(top_stations(t, max_station_num, order), ["eq_id"])  # on narrow rows
    w = event_waveforms(waveforms, event_ids, length)
    top = top.join(w, ["eq_id", "trace_idx"], "left")  # none stored: the slot stays, blanked
    ladder = cutoff_ladder(top, secs)
    return apply_cutoff(ladder, F.col("mask_sec"), rate, length)


def ladder_snapshots(traces: DataFrame, waveforms: DataFrame, event_ids: DataFrame, secs=None, rate: int = 200,
                     length: int = 3000, max_station_num: int = MAX_STATIONS, order: str = "stored",
                     event_time: DataFrame | None = None, station_width: int = 3) -> DataFrame:
    """ST5 in one shuffle of the wide rows: equal to ``assemble_snapshots(snapshot_ladder(...))``,
    but an event's stations are collected once and every horizon is cut from that row as array
    expressions, instead of shuffling a copy of the waveforms per horizon. The kept stations (narrow:
    the columns of a snapshot, with the times of their event) are written once: they name the
    waveforms wanted and then take them, dealt by event. No snapshot is sorted for a join with its time."""
    cols = ["lat", "lon", "elev", "vs30"][:station_width]
    t = traces.join(event_ids.select("eq_id"), "eq_id", "left_semi").select("eq_id", "trace_idx", "p_pick", *cols)
    top = top_stations(t, max_station_num, order)
    if event_time is None:
        top = top.withColumn("_times", F.lit(None).cast("array<struct<event_time:timestamp>>"))
    else:
        times = event_time.groupBy("eq_id").agg(F.collect_list(F.struct("event_time")).alias("_times"))
        top = top.join(times, "eq_id", "left")
    top = pinned(top, "stations")
    top = hydrate_inputs(top, waveforms, length=length)
    member = F.struct("slot", "p_pick", stored_position("waveform", cols).alias("pos"),
                      stored_waveform("waveform", length).alias("waveform"))
    g = top.groupBy("eq_id").agg(F.sort_array(F.collect_list(member)).alias("_in"), F.first("_times").alias("_times"))
    g = g.select("eq_id", "_in", F.inline_outer("_times"))  # event_time: a snapshot per time, NULL without one
    g = cutoff_ladder(g, secs)
    g = g.withColumn("_cutoff", (F.col("_in")[0]["p_pick"] + F.col("mask_sec") * int(rate)).cast("int"))
    g = g.withColumn("_in", mask_members("_in", F.col("_cutoff"), length, station_width))
    n_pad = F.lit(int(max_station_num)) - F.size("_in")
    zero = F.array_repeat(F.lit(0.0).cast("float"), station_width)
    return g.select(
        "eq_id", "mask_sec", "event_time",
        F.concat(F.transform("_in", lambda e: e["waveform"]), F.array_repeat(zero_samples(length), n_pad)).alias("waveform"),
        F.concat(F.transform("_in", lambda e: e["pos"].cast("array<float>")), F.array_repeat(zero, n_pad)).alias("station"))


def assemble_snapshots(ladder: DataFrame, event_time: DataFrame | Column | None = None,
                       max_station_num: int = MAX_STATIONS, length: int = 3000,
                       station_width: int = 3) -> DataFrame:
    """Collect a snapshot's station rows (at most ``max_station_num``) into the JSON shape
    ``waveform[S][T][3]``, ``station[S][3|4]``, zero-padded to ``max_station_num`` slots.

    ``event_time`` is a DataFrame ``(eq_id, event_time)`` or NULL."""
    pos = ["lat", "lon", "elev", "vs30"][:station_width]
    g = (ladder.groupBy("eq_id", "mask_sec")
         .agg(F.sort_array(F.collect_list(F.struct(
             F.col("slot"), F.col("waveform"),
             F.array(*[F.col(c).cast("float") for c in pos]).alias("station")))).alias("_rows")))
    n_pad = F.lit(int(max_station_num)) - F.size("_rows")
    zero_station = F.array_repeat(F.lit(0.0).cast("float"), station_width)
    snap = g.select(
        "eq_id", "mask_sec",
        F.concat(F.transform("_rows", lambda r: r["waveform"]),
                 F.array_repeat(zero_samples(length), n_pad)).alias("waveform"),
        F.concat(F.transform("_rows", lambda r: r["station"]),
                 F.array_repeat(zero_station, n_pad)).alias("station"))
    if isinstance(event_time, DataFrame):
        snap = snap.join(event_time.select("eq_id", "event_time"), "eq_id", "left")
    else:
        snap = snap.withColumn("event_time", F.lit(None).cast("timestamp"))
    return snap.select("eq_id", "mask_sec", "event_time", "waveform", "station")

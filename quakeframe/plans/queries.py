"""Registered queries: each reads the whole test tables through the fixture views and runs
one or more library operators. Names and parameters match ``plans/oracle.py``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.functions.intensity import intensity8, intensity10, intensity_label, scale_table
from quakeframe.operators import catalog as cat
from quakeframe.operators import traces as tr
from quakeframe.operators.balance import class_histogram, label_weights
from quakeframe.functions.embedding import position_embedding
from quakeframe.functions.waveform import log_peak_scale, nonzero_samples, normalise, peak_abs
from quakeframe.operators.masking import apply_cutoff, blind_stations, is_padding, pad_slots, random_cutoff_sec, with_pick0
from quakeframe.operators.samples import (build_samples, hydrate_inputs, hydrate_targets, input_traces,
                                          kept_samples, rank_traces, sample_weights)
from quakeframe.operators.snapshots import event_traces, ladder_snapshots, snapshot_ladder
from quakeframe.functions.mixture import mixture_from_logits, mixture_mean
from quakeframe.operators.evaluate import (ensemble, evaluate, evaluation_points, point_prediction, split_ensemble,
                                           with_exceedance)
from quakeframe.operators.scoring import (AttenuationScorer, masked_input_sets, pad_predictions, score,
                                          scoring_rows, target_groups)
from quakeframe.schema import SNAPSHOT_READ
from quakeframe.session import pinned, shared_dir
from quakeframe.sources import fixtures as fx
from quakeframe.sources import tables
from quakeframe.sources.snapshots_io import (FAST, read_predictions, read_snapshots, validate_snapshots,
                                             write_predictions, write_snapshots)
from quakeframe.streaming.stream import Sinks, archive_consumed, local_time, read_sinks, run_stream, supervise

# Query parameters (shared with the oracle SQL).
MAG_T = 3.0
FIRST_N = 1000
OVERSAMPLE = 1.5
OVERSAMPLE_MAG = 4.0
DECIMATE = 2
R = 6  # decimals kept on computed doubles


def _r(c, n=R):
    return F.round(c, n)


# --- shared sub-plans -------------------------------------------------------

def selected_events(spark, sf_dir, mode="all", mag=0.0):
    ev = cat.select_events(fx.fx_catalog(spark, sf_dir), mag_threshold=mag)
    return cat.split_by_year(ev, mode=mode, test_year=fx.TEST_YEAR)


def selected_traces(spark, sf_dir, mode="all", label="pga", traces=None):
    """Valid traces of selected events, with the event magnitude carried along."""
    ev = selected_events(spark, sf_dir, mode).select("eq_id", "magnitude")
    t = traces if traces is not None else fx.fx_traces(spark, sf_dir)
    return tr.valid_traces(t, label).join(ev, "eq_id")


# --- F / J / S4 -------------------------------------------------------------

def q_events_by_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = cat.select_events(fx.fx_catalog(spark, sf_dir), mag_threshold=MAG_T)
    return ev.select("eq_id", "year", "magnitude")


def q_events_small_sampled(spark, sf_dir):
    ev = cat.select_events(fx.fx_catalog(spark, sf_dir), mag_threshold=MAG_T, part_small_event=True,
                           test_year=fx.TEST_YEAR)
    return ev.select("eq_id", "year", "magnitude", "is_small")


def q_events_small_sampled_exact(spark, sf_dir):
    ev = cat.select_events(fx.fx_catalog(spark, sf_dir), mag_threshold=MAG_T, part_small_event=True,
                           test_year=fx.TEST_YEAR, exact=True)
    return ev.select("eq_id", "year", "magnitude", "is_small")


def q_events_year_split(spark, sf_dir):
    ev = cat.select_events(fx.fx_catalog(spark, sf_dir), mag_threshold=MAG_T)
    parts = [cat.split_by_year(ev, m, fx.TEST_YEAR).select(F.lit(m).alias("mode"), "eq_id", "year")
             for m in ("train", "test")]
    return parts[0].unionByName(parts[1])


def q_events_first_n(spark, sf_dir):
    ev = cat.select_events(fx.fx_catalog(spark, sf_dir), mag_threshold=MAG_T)
    ev = cat.split_by_year(ev, "train", fx.TEST_YEAR)
    return cat.first_events(ev, FIRST_N, "eq_id").select("eq_id", "year", "magnitude")


def q_events_first_half(spark, sf_dir):
    """F4 with a limit that grows with the catalogue."""
    ev = fx.fx_catalog(spark, sf_dir)
    return cat.first_events(ev, ev.count() // 2, "eq_id").select("eq_id", "year", "magnitude")


def q_replay_year_ids(spark, sf_dir):
    return cat.replay_event_ids(fx.fx_catalog(spark, sf_dir), fx.TEST_YEAR)


def q_matched_and_skipped(spark, sf_dir):
    ev = cat.select_events(fx.fx_catalog(spark, sf_dir), mag_threshold=MAG_T).select("eq_id")
    matched, skipped = cat.match_events(ev, fx.fx_traces(spark, sf_dir))
    return (matched.withColumn("contained", F.lit(True))
            .unionByName(skipped.withColumn("contained", F.lit(False))))


def q_event_groups_exploded(spark, sf_dir):
    groups = fx.read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("pga"))
    out = tr.explode_event_groups(groups, "vec_id", ["pga"])
    return out.select("eq_id", "trace_idx", _r(F.col("pga").cast("double")).alias("pga"))


def q_event_groups_parallel(spark, sf_dir):
    """Parallel arrays of unequal length, the label's chosen by key; some events lack an array."""
    e, n, i = F.col("embedding").cast("array<double>"), (20 + F.col("vec_id") % 30).cast("int"), F.col("vec_id")
    whole = F.transform(e, lambda x: F.floor(F.abs(x) * 1000).cast("int"))
    groups = fx.read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(i % 11 != 0, F.slice(e, 1, n)).alias("traces"), F.slice(whole, 1, n - (i % 3).cast("int")).alias("p_pick"),
        F.slice(e, 1, n + 4).alias("pga"), F.slice(whole, 3, n + 9).alias("pga_time"),
        F.when(i % 7 != 0, F.slice(e, 5, n)).alias("pgv"), F.when(i % 7 != 0, F.slice(whole, 2, n)).alias("pgv_time"))
    out = None
    for key in ("pga", "pgv"):
        t = tr.explode_event_groups(groups, "vec_id", ["p_pick"], traces_col="traces", label_key=key)
        t = t.select(F.lit(key).alias("label_key"), "eq_id", "trace_idx", "p_pick", _r(F.col("label")).alias("label"), "label_time")
        out = t if out is None else out.unionByName(t)
    return out


def q_valid_traces(spark, sf_dir):
    counts = (tr.valid_traces(fx.fx_traces(spark, sf_dir), "pga").groupBy("eq_id")
              .agg(F.count(F.lit(1)).alias("n_valid")))
    return counts.join(selected_events(spark, sf_dir).select("eq_id"), "eq_id", "left_semi")


def q_downsample_small(spark, sf_dir):
    t = selected_traces(spark, sf_dir, label="pgv")
    t = tr.downsample_small(t, label="pgv")
    return t.select("eq_id", "trace_idx", _r(F.col("pgv")).alias("label"))


def q_oversample_events(spark, sf_dir):
    ev = selected_events(spark, sf_dir)
    ok = tr.events_with_traces(ev, tr.valid_traces(fx.fx_traces(spark, sf_dir)))
    return tr.oversample_events(ok, OVERSAMPLE, OVERSAMPLE_MAG).select("eq_id", "event_copy")


def q_oversample_traces(spark, sf_dir):
    t = selected_traces(spark, sf_dir)
    return tr.oversample_traces(t).select("eq_id", "trace_idx", F.col("trace_copy").cast("int").alias("trace_copy"))


def q_pick_decimation(spark, sf_dir):
    t = tr.decimate_picks(fx.fx_traces(spark, sf_dir), DECIMATE)
    return t.select("eq_id", "trace_idx", "p_pick")


# --- intensity / balancing --------------------------------------------------

def q_intensity10_pga_pgv(spark, sf_dir):
    t = selected_traces(spark, sf_dir)
    cls = intensity10("pga", "pgv")
    return t.select("eq_id", "trace_idx", cls.alias("intensity"), intensity_label(cls).alias("intensity_label"))


def q_intensity8_classes(spark, sf_dir):
    return class_histogram(selected_traces(spark, sf_dir), "pga")


def q_label_weights(spark, sf_dir):
    ev = selected_events(spark, sf_dir).select("eq_id")
    w = label_weights(fx.fx_traces(spark, sf_dir).join(ev, "eq_id"), "pga")  # unlabelled traces too
    return w.select("eq_id", "trace_idx", "class", "weight")


def q_intensity_ticks(spark, sf_dir):
    t = selected_traces(spark, sf_dir)
    counts = (t.select(intensity10("pga").alias("c_pga"), intensity10("pgv").alias("c_pgv"))
              .select(F.explode(F.array(
                  F.struct(F.lit("pga").alias("target"), F.col("c_pga").alias("class")),
                  F.struct(F.lit("pgv").alias("target"), F.col("c_pgv").alias("class")))).alias("x"))
              .groupBy("x.target", "x.class").agg(F.count(F.lit(1)).alias("n_traces")))
    scale = scale_table(spark)
    out = scale.join(F.broadcast(counts), ["target", "class"], "left")  # at most 20 counts
    return out.select("target", "class", "label", _r(F.col("threshold")).alias("threshold"),
                      _r(F.col("tick")).alias("tick"), "display_line",
                      F.coalesce(F.col("n_traces"), F.lit(0)).alias("n_traces"))


# --- ranking and samples ----------------------------------------------------

def q_rank_by_pick(spark, sf_dir):
    """W1/W2."""
    r = rank_traces(selected_traces(spark, sf_dir), max_station_num=fx.MAX_STATIONS_FX,
                    pin=False)  # one consumer: nothing to pin
    return r.select("eq_id", "trace_idx", "pos", "chunk_no", "slot", "n_chunks")


def _samples(spark, sf_dir, bias=False, weights=False, mode="all"):
    t = selected_traces(spark, sf_dir, mode=mode)
    if weights:
        t = label_weights(t, "pga")
    r = rank_traces(t, max_station_num=fx.MAX_STATIONS_FX)
    return build_samples(r, bias_to_closer_station=bias)


def q_build_samples(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return s.select("sample_id", "eq_id", "event_copy", "chunk_no", "is_bias", "side", "slot", "trace_idx")


def q_build_samples_bias(spark, sf_dir):
    t = tr.valid_traces(fx.fx_wide_traces(spark, sf_dir), "pga")
    r = rank_traces(t, max_station_num=fx.WIDE_CHUNK)
    s = build_samples(r, bias_to_closer_station=True)
    return (s.groupBy("sample_id", "eq_id", "event_copy", "chunk_no", "is_bias")
            .agg(F.count(F.when(F.col("side") == "input", 1)).alias("n_inputs"),
                 F.count(F.when(F.col("side") == "target", 1)).alias("n_targets"),
                 F.min(F.when(F.col("side") == "target", F.col("pos"))).alias("min_target_pos"),
                 F.max(F.when(F.col("side") == "target", F.col("pos"))).alias("max_target_pos")))


def q_sample_weights(spark, sf_dir):
    s = _samples(spark, sf_dir, bias=True, weights=True)
    w = sample_weights(s)
    return w.select("sample_id", "eq_id", "chunk_no", "is_bias", _r(F.col("weight"), 9).alias("weight"),
                    "n_targets")


def q_test_year_sample_summary(spark, sf_dir):
    """Flagship: for each test-year event and chunk, the number of samples of the event,
    targets in the chunk, strongest 8-class intensity and mean label."""
    s = _samples(spark, sf_dir, mode="test")
    tg = s.filter(F.col("side") == "target")
    return (tg.groupBy("eq_id", "chunk_no")
            .agg(F.max("n_chunks").alias("n_samples"), F.count(F.lit(1)).alias("n_targets"),
                 F.max(intensity8("pga")).alias("max_class"), _r(F.avg("pga")).alias("mean_label")))


# --- hydration, masking, replay, features ------------------------------------

MASK_SEC = 3
INPUT_COLS = ("eq_id", "trace_idx", "p_pick", "lat", "lon", "elev", "vs30")  # what an input set takes of its traces
T_PAD = 24    # 12 s at 2 Hz: longer than the 22 stored samples, so traces are padded
T_CROP = 20   # 10 s at 2 Hz: shorter, so traces are cropped


def _wsum(w):
    return F.aggregate(F.flatten(w), F.lit(0.0), lambda a, x: a + x)


def _wave_stats(w):
    return [F.size(w).alias("n_samples"), nonzero_samples(w).alias("n_nonzero"),
            _r(peak_abs(w)).alias("peak"), _r(_wsum(w)).alias("wsum")]


def q_hydrate_inputs(spark, sf_dir):
    """Chunk 0 fetches its waveforms once per event (unique trace keys), then the
    hydrated rows are copied into every sample by the salted chunk-bucket join."""
    t = selected_traces(spark, sf_dir).select(*INPUT_COLS)
    r = rank_traces(t, max_station_num=fx.MAX_STATIONS_FX, pin=False)
    c0 = hydrate_inputs(r.filter(F.col("chunk_no") == 0), fx.fx_waveforms(spark, sf_dir))
    h = build_samples(r, inputs=c0).filter(F.col("side") == "input")
    return h.select("sample_id", "slot", "trace_idx", "lat", "lon", "elev", "vs30", "p_pick",
                    F.coalesce(F.size("waveform"), F.lit(0)).alias("n_samples"), _r(peak_abs("waveform")).alias("peak"))


def q_hydrate_from_store(spark, sf_dir):
    """J5 against the bucketed store, which half of the events were added to later."""
    table, w = f"waveforms_{uuid.uuid4().hex}", fx.fx_waveforms(spark, sf_dir)
    late = F.col("eq_id") % 2 == 1
    tables.write_waveform_store(w.filter(~late), table, shared_dir(spark, "waveforms"), buckets=16)
    tables.append_waveforms(w.filter(late), table)
    r = rank_traces(selected_traces(spark, sf_dir).select(*INPUT_COLS), max_station_num=fx.MAX_STATIONS_FX, pin=False)
    h = tables.hydrate_from_store(r.filter(F.col("chunk_no") == 0), table)
    return h.select("eq_id", "slot", "trace_idx", F.coalesce(F.size("waveform"), F.lit(0)).alias("n_samples"),
                    _r(peak_abs("waveform")).alias("peak"))


def q_hydrate_targets(spark, sf_dir):
    h = hydrate_targets(_samples(spark, sf_dir))
    return h.select("sample_id", "slot", "trace_idx",
                    *[F.col("target_pos")[i].alias(c) for i, c in enumerate(["lat", "lon", "elev", "vs30"])],
                    _r(F.col("label")).alias("label"), "p_pick", "label_time")


def q_event_traces_cropped(spark, sf_dir):
    ids = cat.replay_event_ids(fx.fx_catalog(spark, sf_dir), fx.TEST_YEAR)
    et = event_traces(ids, fx.fx_traces(spark, sf_dir, fx.WAVE_PICK_DIVISOR, ids), fx.fx_waveforms(spark, sf_dir, ids), T_CROP)
    return et.select("eq_id", "trace_idx", F.coalesce(F.size("waveform"), F.lit(0)).alias("n_samples"),
                     _r(peak_abs("waveform")).alias("peak"), "lat", "lon", "elev", "p_pick")


def q_snapshot_slots(spark, sf_dir):
    s = _samples(spark, sf_dir)
    fill = {"lat": 0.0, "lon": 0.0, "elev": 0.0, "vs30": 0.0, "pga": 0.0}
    p = pad_slots(s.select("sample_id", "side", "slot", "lat", "lon", "elev", "vs30", "pga", "chunk_size"),
                  ["sample_id", "side"], fx.MAX_STATIONS_FX, fill=fill, size_col="chunk_size")
    return p.select("sample_id", "side", "slot", "is_padding", "lat", "lon", "elev", "vs30",
                    F.when(F.col("side") == "target", _r(F.col("pga"))).alias("label"))


def _masked_inputs(spark, sf_dir, sec=MASK_SEC, length=T_PAD):
    t = selected_traces(spark, sf_dir, traces=fx.fx_traces(spark, sf_dir, fx.WAVE_PICK_DIVISOR)).select(*INPUT_COLS)
    r = rank_traces(t, max_station_num=fx.MAX_STATIONS_FX, pin=False)
    kept = kept_samples(r, sec, fx.WAVE_RATE, length)  # the mask zeroes the rest
    inputs = hydrate_inputs(input_traces(r), fx.fx_waveforms(spark, sf_dir), flag=True, length=kept)
    return apply_cutoff(inputs, sec, fx.WAVE_RATE, length)


def q_crop_pad_mask(spark, sf_dir):
    m = _masked_inputs(spark, sf_dir)
    return m.select("eq_id", "slot", "trace_idx", *_wave_stats(F.col("waveform")))


def q_blank_late_stations(spark, sf_dir):
    m = _masked_inputs(spark, sf_dir)
    return m.select("eq_id", "slot", "trace_idx", "p_pick", "pick0", "cutoff", "blanked", "lat", "lon")


def _ladder(spark, sf_dir):
    ids = cat.replay_event_ids(fx.fx_catalog(spark, sf_dir), fx.TEST_YEAR)
    return snapshot_ladder(fx.fx_traces(spark, sf_dir, fx.WAVE_PICK_DIVISOR, ids), fx.fx_waveforms(spark, sf_dir, ids), ids,
                           secs=[3, 5, 7, 10], rate=fx.WAVE_RATE, length=T_CROP,
                           max_station_num=fx.MAX_STATIONS_FX, order="stored")


def _ladder_snapshots(spark, sf_dir, times=None):
    ids = cat.replay_event_ids(fx.fx_catalog(spark, sf_dir), fx.TEST_YEAR)
    lines = pinned(fx.numbered_lines(spark, sf_dir, ids).select(*fx.LINE_COLUMNS), "lines")  # numbered once for both
    return ladder_snapshots(fx.fx_traces(spark, sf_dir, fx.WAVE_PICK_DIVISOR, lines=lines), fx.fx_waveforms(spark, sf_dir, lines=lines), ids,
                            secs=[3, 5, 7, 10], rate=fx.WAVE_RATE, length=T_CROP, max_station_num=fx.MAX_STATIONS_FX,
                            order="stored", event_time=times)


def q_cutoff_ladder(spark, sf_dir):
    lad = _ladder(spark, sf_dir)
    return lad.select("eq_id", "mask_sec", "slot", "trace_idx", "blanked",
                      nonzero_samples("waveform").alias("n_nonzero"), _r(peak_abs("waveform")).alias("peak"))


def _sample_inputs(spark, sf_dir):
    t = selected_traces(spark, sf_dir, traces=fx.fx_traces(spark, sf_dir, fx.WAVE_PICK_DIVISOR))
    s = build_samples(rank_traces(t, max_station_num=fx.MAX_STATIONS_FX))
    return with_pick0(s.filter(F.col("side") == "input"), ["sample_id"])


def q_random_cutoff(spark, sf_dir):
    rows = _sample_inputs(spark, sf_dir).withColumn("mask_sec", random_cutoff_sec(["sample_id"], MASK_SEC))
    m = apply_cutoff(rows, F.col("mask_sec"), fx.WAVE_RATE, T_PAD)
    return (m.groupBy("sample_id", "mask_sec")
            .agg(F.count(F.lit(1)).alias("n_inputs"), F.count(F.when(F.col("blanked"), 1)).alias("n_blanked")))


def q_station_blinding(spark, sf_dir):
    m = apply_cutoff(_sample_inputs(spark, sf_dir), MASK_SEC, fx.WAVE_RATE, T_PAD)
    b = blind_stations(m, ["sample_id"])
    return b.select("sample_id", "slot", "blanked", "blinded")


def q_peak_abs_log_scale(spark, sf_dir):
    w = fx.fx_waveforms(spark, sf_dir).withColumn("peak", peak_abs("samples"))
    return w.select("eq_id", "trace_idx", _r(F.col("peak")).alias("peak"),
                    _r(log_peak_scale(F.col("peak"))).alias("log_scale"))


def q_normalised_waveform(spark, sf_dir):
    w = fx.fx_waveforms(spark, sf_dir).withColumn("peak", peak_abs("samples"))
    flat = F.flatten(normalise("samples", F.col("peak")))
    return w.select("eq_id", "trace_idx", _r(F.array_max(flat)).alias("nmax"), _r(F.array_min(flat)).alias("nmin"),
                    _r(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x)).alias("nsum"))


def q_position_embedding(spark, sf_dir):
    st = fx.fx_stations(spark, sf_dir)
    e = st.select("station_id", F.posexplode(position_embedding("lat", "lon", "elev")).alias("j", "v"))
    return e.select("station_id", F.col("j").cast("int").alias("j"), _r(F.col("v")).alias("value"))


def q_padding_flags(spark, sf_dir):
    snaps = _ladder_snapshots(spark, sf_dir)
    st = F.col("station")
    return snaps.select(
        "eq_id", "mask_sec", F.size(st).alias("n_slots"),
        F.size(F.filter(st, lambda s: ~is_padding(s))).alias("n_real"),
        F.size(F.filter(st, is_padding)).alias("n_padding"),
        F.size(F.filter(st, lambda s: F.forall(s, lambda x: x != 0))).alias("n_all_nonzero"))


# --- scoring, ensemble, evaluation, IO, streaming -----------------------------

# Fixed test models (FIXTURES.md B8): (alpha, beta, name).
MODEL_PARAMS = [(0.5, 0.3, "a"), (1.0, 0.5, "b")]
ROUTES = [("south", 0.0, 23.5), ("north", 23.5, 90.0)]
STREAM_TIMEOUT = 1800  # seconds; a stream that does not end by then is reported as running


def models():
    return [AttenuationScorer(a, b, n) for a, b, n in MODEL_PARAMS]


def _predictions(spark, sf_dir, secs=(MASK_SEC,)):
    """P2 + E7: the test-year samples scored by both models in one pass, at every cut-off."""
    ids = selected_events(spark, sf_dir, "test").select("eq_id")
    t = selected_traces(spark, sf_dir, mode="test", traces=fx.fx_traces(spark, sf_dir, fx.WAVE_PICK_DIVISOR, ids))
    r = rank_traces(t, max_station_num=fx.MAX_STATIONS_FX)
    c0 = hydrate_inputs(r.filter(F.col("chunk_no") == 0), fx.fx_waveforms(spark, sf_dir, ids))
    sets = masked_input_sets(c0, ["eq_id"], fx.MAX_STATIONS_FX, T_PAD, list(secs), fx.WAVE_RATE)
    fields = ["chunk_no", "slot", "trace_idx", "p_pick", "label_time", "answer", "lat", "lon", "elev", "vs30",
              "chunk_size"]
    tg = r.select("eq_id", *fields[:4], F.col("pga_time").alias("label_time"), F.col("pga").alias("answer"),
                  "lat", "lon", "elev", "vs30", "chunk_size")
    rows = scoring_rows(sets, target_groups(tg, ["eq_id"], fields), ["eq_id"])
    scored = score(rows, models(), ["eq_id", "mask_sec"])
    return scored.select(
        "model", "mask_sec", F.concat_ws("/", F.col("eq_id"), F.lit(0), F.col("target.chunk_no"), F.lit(0)).alias("sample_id"),
        F.col("target.slot").alias("slot"), "eq_id", F.col("target.p_pick").alias("p_pick"),
        F.col("target.label_time").alias("label_time"), "predict", F.col("target.answer").alias("answer"),
        F.col("target.lat").alias("latitude"), F.col("target.lon").alias("longitude"),
        F.col("target.elev").alias("elevation"), F.col("target.chunk_size").alias("chunk_size"), "mixture")


_PRED_COLS = ["model", "sample_id", "slot", "eq_id", "p_pick", "label_time"]


def _pred_out(p):
    return p.select(*_PRED_COLS, _r(F.col("predict")).alias("predict"), _r(F.col("answer")).alias("answer"),
                    "latitude", "longitude", "elevation")


def q_score_two_models(spark, sf_dir):
    return _pred_out(_predictions(spark, sf_dir))


def q_predictions_real_only(spark, sf_dir):
    p = pad_predictions(_predictions(spark, sf_dir).drop("mixture", "mask_sec"), ["model", "sample_id"], fx.MAX_STATIONS_FX)
    return p.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.count(F.when(F.col("is_real"), 1)).alias("n_real"),
                                  F.count(F.when(F.col("answer") != 0, 1)).alias("n_answer_nonzero"))


def q_mixture_mean(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return p.select("model", "sample_id", "slot", _r(mixture_mean("mixture")).alias("mix_mean"))


def q_exceedance(spark, sf_dir):
    p = with_exceedance(_predictions(spark, sf_dir))
    return p.select("model", "sample_id", "slot", _r(F.col("exceedance")).alias("exceedance"))


def q_ensemble_mean(spark, sf_dir):
    e, _ = split_ensemble(ensemble(_predictions(spark, sf_dir), ["sample_id", "slot"]), len(MODEL_PARAMS))
    return e.select("sample_id", "slot", "eq_id", _r(F.col("predict")).alias("predict"),
                    _r(F.col("answer")).alias("answer"), "n_models")


def _eval_out(e):
    return e.select(*[c for c in e.columns if c in ("model",)], "n", _r(F.col("r2")).alias("r2"),
                    _r(F.col("lim_lo")).alias("lim_lo"), _r(F.col("lim_hi")).alias("lim_hi"))


def q_evaluate_r2(spark, sf_dir):
    return _eval_out(evaluate(_predictions(spark, sf_dir), ["model"]))


def q_ensemble_report(spark, sf_dir):
    e, _ = split_ensemble(ensemble(_predictions(spark, sf_dir), ["sample_id", "slot"]), len(MODEL_PARAMS))
    return _eval_out(evaluate(e.withColumn("model", F.lit("ensemble")), ["model"]))


def q_ensemble_rejected(spark, sf_dir):
    """The keys that an ensemble cannot take, where model b lacks some events and has
    another answer for others."""
    p, b = _predictions(spark, sf_dir), F.col("model") == "b"
    p = p.filter(~(b & (F.col("eq_id") % 5 == 0)))
    p = p.withColumn("answer", F.when(b & (F.col("eq_id") % 7 == 0), F.col("answer") + 1).otherwise(F.col("answer")))
    _, bad = split_ensemble(ensemble(p, ["sample_id", "slot"]), len(MODEL_PARAMS))
    return bad.select("sample_id", "slot", "eq_id", "n_models", "answer_mismatch")


def q_evaluation_points(spark, sf_dir):
    """Each point of the evaluation plot with its place on the intensity scale."""
    p = evaluation_points(_predictions(spark, sf_dir).select("model", "sample_id", "slot", "answer", "predict"), "pga", ["model"])
    whole = {"answer", "predict", "answer_threshold", "answer_tick", "predict_threshold", "predict_tick", "r2", "lim_lo", "lim_hi"}
    return p.select(*[_r(F.col(c)).alias(c) if c in whole else c for c in p.columns])


CUTOFFS = (3, 5, 7, 10)


def q_ensemble_by_cutoff(spark, sf_dir):
    """P5: predictions of every cut-off written and read back, averaged per (cut-off, sample,
    slot); the ensemble is written and read back too, then evaluated per cut-off."""
    path = shared_dir(spark, "predictions")
    write_predictions(_predictions(spark, sf_dir, CUTOFFS), path, compression="gzip")
    e = ensemble(read_predictions(spark, path, with_cutoff=True), ["mask_sec", "sample_id", "slot"])
    good, _ = split_ensemble(e, len(MODEL_PARAMS))
    path = shared_dir(spark, "ensemble")
    write_predictions(good.withColumn("model", F.lit("ensemble")), path, compression="gzip")
    r = evaluate(read_predictions(spark, path, with_cutoff=True), ["mask_sec"])
    return r.select("mask_sec", "n", _r(F.col("r2")).alias("r2"), _r(F.col("lim_lo")).alias("lim_lo"), _r(F.col("lim_hi")).alias("lim_hi"))


def q_point_prediction(spark, sf_dir):
    """M6 from both sources: the mixture mean and the given prediction."""
    p = _predictions(spark, sf_dir)
    both = [point_prediction(p, a).select(F.lit(a).alias("agg"), "model", "sample_id", "slot", _r(F.col("point")).alias("point"))
            for a in ("mean", "point")]
    return both[0].unionByName(both[1])


def q_predictions_csv_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "predictions")
    write_predictions(_predictions(spark, sf_dir), path, compression="gzip")
    return _pred_out(read_predictions(spark, path))


def q_mixture_from_logits(spark, sf_dir):
    emb = fx.read_table(spark, sf_dir, "embeddings")
    mix = emb.select("vec_id", mixture_from_logits(F.slice("embedding", 1, 5), F.slice("embedding", 6, 5),
                                                   F.slice("embedding", 11, 5)).alias("mixture"))
    j = fx.fx_trace_vectors(spark, sf_dir).join(mix, "vec_id")
    return j.select("eq_id", "trace_idx", _r(mixture_mean("mixture")).alias("mix_mean"),
                    _r(F.array_max(F.transform("mixture", lambda c: c["weight"]))).alias("w_max"),
                    _r(F.array_max(F.transform("mixture", lambda c: c["sigma"]))).alias("sigma_max"),
                    _r(F.aggregate("mixture", F.lit(0.0), lambda a, c: a + c["weight"])).alias("w_sum"))


def q_local_time(spark, sf_dir):
    e = fx.read_table(spark, sf_dir, "events")
    naive = dict(e.dtypes)["ts"] == "timestamp_ntz"
    return e.select("event_id", local_time("ts", naive=naive).alias("local_ts"))


def _snapshots(spark, sf_dir):
    times = fx.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("eq_id"),
                                                          F.col("o_orderdate").alias("event_time"))
    return _ladder_snapshots(spark, sf_dir, times)


PACKED = "gzip"  # snapshot lines

BAD_KINDS = 8  # eq_id % 8 picks what is wrong with an event's snapshot lines; 0 and 7: nothing


def _lines(spark, sf_dir):
    """Snapshot lines as text, most of them broken in a way that depends on the event."""
    w, st, kind = F.col("waveform"), F.col("station"), F.col("eq_id") % BAD_KINDS
    cut = lambda c: F.slice(c, 1, F.size(c) - 1)
    first = lambda c, x: F.concat(F.array(x), F.slice(c, 2, fx.MAX_STATIONS_FX))
    none = F.lit(None)
    waveform = (F.when(kind == 2, first(w, cut(w[0]))).when(kind.isin(3, 4), cut(w))
                .when(kind == 5, none.cast("array<array<array<float>>>")).otherwise(w))
    station = F.when(kind == 3, cut(st)).when(kind == 6, first(st, cut(st[0]))).otherwise(st)
    s = _snapshots(spark, sf_dir).select(F.col("event_time").cast("timestamp").alias("event_time"), waveform.alias("waveform"), station.alias("station"), "eq_id", "mask_sec")
    line = F.to_json(F.struct("event_time", "waveform", "station", "eq_id", "mask_sec"),
                     {"timestampFormat": "yyyy-MM-dd HH:mm:ss", "ignoreNullFields": "false"})
    return s.select(F.when(kind == 1, F.substring(line, 1, 60)).otherwise(line).alias("value"))


def _validated(spark, sf_dir):
    path = shared_dir(spark, "snapshots")
    _lines(spark, sf_dir).write.options(**FAST).text(path, compression=PACKED)
    return validate_snapshots(read_snapshots(spark, path), n_stations=fx.MAX_STATIONS_FX, length=T_CROP)


def q_validate_snapshot_lines(spark, sf_dir):
    """Each snapshot line with its reason; a corrupt one has no ids."""
    n = F.when(F.col("waveform").isNotNull(), F.size("waveform"))
    return _validated(spark, sf_dir).select("eq_id", "mask_sec", "valid", "reason", n.alias("n_stations"))


def q_validate_snapshots(spark, sf_dir):
    v = _validated(spark, sf_dir)
    return v.groupBy("valid", "reason").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("eq_id").alias("n_events"))


def _ended(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _counted(spark, sink):
    """Targets per route and rejected lines per reason that a stream has written."""
    got = read_sinks(spark, Sinks.at(sink))
    n = F.count(F.lit(1)).alias("n")
    good = got["predictions"].groupBy("route").agg(n).select(F.lit("scored").alias("kind"), F.col("route").alias("name"), "n")
    bad = got["quarantine"].groupBy("reason").agg(n).select(F.lit("rejected").alias("kind"), F.col("reason").alias("name"), "n")
    return good.unionByName(bad)


def q_stream_quarantined(spark, sf_dir):
    """ST1/ST2 + D13: broken lines in the stream land in the quarantine, the others are scored and routed."""
    src, sink, ckpt = (shared_dir(spark, n) for n in ("stream-src", "stream-sink", "stream-ckpt"))
    _lines(spark, sf_dir).write.options(**FAST).text(src, compression=PACKED)
    _ended(run_stream(spark, src, sink, ckpt, models(), rules=ROUTES, max_files=4))
    # The stream accepts any number of stations and samples: only broken lines are rejected.
    return _counted(spark, sink)


def q_stream_restarted(spark, sf_dir):
    """ST1/S10/P3: the first batch dies after its predictions are written, before quarantine and
    report; the restarted stream replaces them, and all three sinks agree."""
    src, sink, ckpt = (shared_dir(spark, n) for n in ("stream-src", "stream-sink", "stream-ckpt"))
    _lines(spark, sf_dir).write.options(**FAST).text(src, compression=PACKED)

    def die(kind, batch_id):
        raise RuntimeError(f"lost after {kind} of batch {batch_id}")

    q = run_stream(spark, src, sink, ckpt, models(), rules=ROUTES, max_files=4, on_written=die)
    status = supervise(spark, {"first": q}, timeout=STREAM_TIMEOUT).first()
    if status["state"] != "failed":
        raise RuntimeError(f"the stream should have died: {status}")
    _ended(run_stream(spark, src, sink, ckpt, models(), rules=ROUTES, max_files=4))
    r = read_sinks(spark, Sinks.at(sink))["report"]
    kinds = ("snapshots", "rejected", "predictions")
    r = r.agg(*[F.sum(f"n_{k}").alias(k) for k in kinds]).select(F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))])))
    return _counted(spark, sink).unionByName(r.select(F.lit("reported").alias("kind"), F.col("key").alias("name"), F.col("value").alias("n")))


def q_stream_live_status(spark, sf_dir):
    """ST3/ST4: two live queries on a processing-time trigger; one dies in its first batch, the
    other goes on until its source is used up."""
    src = shared_dir(spark, "stream-src")
    write_snapshots(_snapshots(spark, sf_dir), src, partition_by=None, compression=PACKED)

    def die(kind, batch_id):
        raise RuntimeError("sink is gone")

    sinks = {n: shared_dir(spark, "stream-sink") for n in ("sound", "broken")}
    live = {n: run_stream(spark, src, sink, shared_dir(spark, "stream-ckpt"), models(), max_files=4, trigger={"processingTime": "1 second"},
                          on_written=die if n == "broken" else None) for n, sink in sinks.items()}
    status = supervise(spark, live, timeout=STREAM_TIMEOUT)
    told = None
    for n, sink in sinks.items():
        r = spark.createDataFrame([], "n_predictions long") if n == "broken" else read_sinks(spark, Sinks.at(sink))["report"]
        one = r.agg(F.coalesce(F.sum("n_predictions"), F.lit(0)).alias("n_predictions")).withColumn("name", F.lit(n))
        told = one if told is None else told.unionByName(one)
    return status.join(told, "name").select("name", "state", F.col("error").contains("sink is gone").alias("told"), "n_predictions")


def _run_stream(spark, sf_dir, rules=None):
    src, sink, ckpt = (shared_dir(spark, n) for n in ("stream-src", "stream-sink", "stream-ckpt"))
    write_snapshots(_snapshots(spark, sf_dir), src, partition_by=None, compression=PACKED)  # as many files as partitions
    _ended(run_stream(spark, src, sink, ckpt, models(), rules=rules, max_files=4))
    return read_sinks(spark, Sinks.at(sink))["predictions"]


def q_snapshots_batch_scored(spark, sf_dir):
    """The replay snapshots written as JSON, read back in batch and scored (self-targets).
    Same result as the streamed version."""
    from quakeframe.streaming.stream import score_snapshots

    path = shared_dir(spark, "batch-snapshots")
    write_snapshots(_snapshots(spark, sf_dir), path, partition_by=None, compression=PACKED)
    out = score_snapshots(read_snapshots(spark, path), models())
    return out.select("eq_id", "mask_sec", "model", "slot", _r(F.col("predict")).alias("predict"))


def q_stream_scored(spark, sf_dir):
    out = _run_stream(spark, sf_dir)
    return out.select("eq_id", "mask_sec", "model", "slot", _r(F.col("predict")).alias("predict"))


def q_stream_routed(spark, sf_dir):
    out = _run_stream(spark, sf_dir, rules=ROUTES)
    return out.select("eq_id", "mask_sec", "model", "slot", "route", _r(F.col("predict")).alias("predict"))


def q_stream_archived(spark, sf_dir):
    """Consumed files are moved, whole; a second stream over the source finds nothing to read."""
    src, sink, archive = (shared_dir(spark, n) for n in ("stream-src", "stream-sink", "stream-archive"))
    write_snapshots(_snapshots(spark, sf_dir), src, partition_by=None, compression=PACKED)
    _ended(run_stream(spark, src, sink, shared_dir(spark, "stream-ckpt"), models(), max_files=4, archive_dir=archive))
    archive_consumed(spark, Sinks.at(sink), archive)
    again = shared_dir(spark, "stream-sink")
    _ended(run_stream(spark, src, again, shared_dir(spark, "stream-ckpt"), models(), max_files=4))
    kept = spark.read.schema(SNAPSHOT_READ).option("recursiveFileLookup", True).json(archive)
    first = read_sinks(spark, Sinks.at(sink))["predictions"].agg(F.count(F.lit(1)).alias("n"))
    second = spark.read.schema(SNAPSHOT_READ).json(src).agg(F.count(F.lit(1)).alias("n"))
    return (first.select(F.lit("predictions").alias("name"), "n")
            .unionByName(kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("archived lines").alias("name"), "n"))
            .unionByName(second.select(F.lit("lines left").alias("name"), "n")))


def q_stream_routed_by_table(spark, sf_dir):
    """ST2: overlapping latitude rules kept as a table; the first match by priority wins."""
    path, key = shared_dir(spark, "rules"), F.col("n_nationkey")
    low = F.lit(21.0) + key * F.lit(0.2)
    rules = fx.read_table(spark, sf_dir, "nation").select(
        (key % 7).alias("priority"), F.col("n_name").alias("name"), low.alias("lat_min"),
        F.when(key % 10 != 9, low + F.lit(0.9)).alias("lat_max"))
    rules.write.parquet(path)
    out = _run_stream(spark, sf_dir, rules=path)
    return out.select("eq_id", "mask_sec", "model", "slot", "route", _r(F.col("predict")).alias("predict"))


def q_canonical_tables(spark, sf_dir):
    """S3: catalogue, traces and waveforms stored as Parquet (under other column names) and
    read back through the canonical-schema readers."""
    paths = {n: shared_dir(spark, n) for n in ("catalog", "traces", "waveforms")}
    fx.fx_catalog(spark, sf_dir).withColumnRenamed("magnitude", "ml").write.parquet(paths["catalog"])
    fx.fx_traces(spark, sf_dir).withColumnRenamed("p_pick", "p").drop("station_name").write.parquet(paths["traces"])
    fx.fx_waveforms(spark, sf_dir).withColumnRenamed("samples", "xyz").write.parquet(paths["waveforms"])
    c = tables.read_catalog(spark, paths["catalog"], {"magnitude": "ml"})
    t = tables.read_traces(spark, paths["traces"], {"p_pick": "p"})
    w = tables.read_waveforms(spark, paths["waveforms"], {"samples": "xyz"})
    n = F.count(F.lit(1)).alias("n_rows")
    parts = [c.agg(n, F.sum(F.col("year").cast("long")).alias("total")), t.agg(n, F.sum(F.col("p_pick").cast("long")).alias("total")),
             w.agg(n, F.sum(F.size("samples").cast("long")).alias("total"))]
    named = [p.select(F.lit(name).alias("name"), "n_rows", "total") for name, p in zip(paths, parts)]
    return named[0].unionByName(named[1]).unionByName(named[2])


# --- the full data-set builder -------------------------------------------------

def dataset_options():
    from quakeframe.plans.dataset import DatasetOptions

    return DatasetOptions(sampling_rate=fx.WAVE_RATE, data_length_sec=12, test_year=fx.TEST_YEAR, mode="train",
                          label_key="pgv", mask_waveform_sec=MASK_SEC, mask_waveform_random=True,
                          downsampling=True, oversample=OVERSAMPLE, oversample_mag=OVERSAMPLE_MAG,
                          max_station_num=fx.MAX_STATIONS_FX, label_target=fx.MAX_STATIONS_FX,
                          oversample_by_labels=True, mag_threshold=MAG_T, part_small_event=True,
                          weight_label=True, station_blind=True, bias_to_closer_station=True)


def dataset_test_options():
    """The prediction flow's configuration: test year only, fixed 3 s cut-off, PGA labels."""
    from quakeframe.plans.dataset import DatasetOptions

    return DatasetOptions(sampling_rate=fx.WAVE_RATE, data_length_sec=12, test_year=fx.TEST_YEAR, mode="test",
                          label_key="pga", mask_waveform_sec=MASK_SEC, max_station_num=fx.MAX_STATIONS_FX,
                          label_target=fx.MAX_STATIONS_FX)


def q_dataset_test_samples(spark, sf_dir):
    from quakeframe.plans.dataset import build_dataset, dataset_summary

    ds = build_dataset(fx.fx_catalog(spark, sf_dir), fx.fx_traces(spark, sf_dir, fx.WAVE_PICK_DIVISOR),
                       fx.fx_waveforms(spark, sf_dir), dataset_test_options())
    return dataset_summary(ds)


def q_dataset_samples(spark, sf_dir):
    """The whole builder: selection, small-event sample, balancing, copies, weights, ranking,
    chunking with bias samples, hydration, random horizons, blanking, blinding, padding."""
    from quakeframe.plans.dataset import build_dataset, dataset_summary

    ds = build_dataset(fx.fx_catalog(spark, sf_dir), fx.fx_traces(spark, sf_dir, fx.WAVE_PICK_DIVISOR),
                       fx.fx_waveforms(spark, sf_dir), dataset_options())
    return dataset_summary(ds)


QUERIES = {
    "events_by_magnitude": q_events_by_magnitude,
    "events_small_sampled": q_events_small_sampled,
    "events_small_sampled_exact": q_events_small_sampled_exact,
    "events_year_split": q_events_year_split,
    "events_first_n": q_events_first_n,
    "events_first_half": q_events_first_half,
    "replay_year_ids": q_replay_year_ids,
    "matched_and_skipped": q_matched_and_skipped,
    "event_groups_exploded": q_event_groups_exploded,
    "event_groups_parallel": q_event_groups_parallel,
    "valid_traces": q_valid_traces,
    "downsample_small": q_downsample_small,
    "oversample_events": q_oversample_events,
    "oversample_traces": q_oversample_traces,
    "pick_decimation": q_pick_decimation,
    "intensity10_pga_pgv": q_intensity10_pga_pgv,
    "intensity8_classes": q_intensity8_classes,
    "label_weights": q_label_weights,
    "intensity_ticks": q_intensity_ticks,
    "rank_by_pick": q_rank_by_pick,
    "build_samples": q_build_samples,
    "build_samples_bias": q_build_samples_bias,
    "sample_weights": q_sample_weights,
    "test_year_sample_summary": q_test_year_sample_summary,
    "hydrate_inputs": q_hydrate_inputs,
    "hydrate_from_store": q_hydrate_from_store,
    "hydrate_targets": q_hydrate_targets,
    "event_traces_cropped": q_event_traces_cropped,
    "snapshot_slots": q_snapshot_slots,
    "crop_pad_mask": q_crop_pad_mask,
    "blank_late_stations": q_blank_late_stations,
    "cutoff_ladder": q_cutoff_ladder,
    "random_cutoff": q_random_cutoff,
    "station_blinding": q_station_blinding,
    "peak_abs_log_scale": q_peak_abs_log_scale,
    "normalised_waveform": q_normalised_waveform,
    "position_embedding": q_position_embedding,
    "padding_flags": q_padding_flags,
    "score_two_models": q_score_two_models,
    "predictions_real_only": q_predictions_real_only,
    "mixture_mean": q_mixture_mean,
    "exceedance": q_exceedance,
    "ensemble_mean": q_ensemble_mean,
    "evaluate_r2": q_evaluate_r2,
    "ensemble_report": q_ensemble_report,
    "ensemble_by_cutoff": q_ensemble_by_cutoff,
    "ensemble_rejected": q_ensemble_rejected,
    "evaluation_points": q_evaluation_points,
    "point_prediction": q_point_prediction,
    "predictions_csv_roundtrip": q_predictions_csv_roundtrip,
    "mixture_from_logits": q_mixture_from_logits,
    "local_time": q_local_time,
    "validate_snapshots": q_validate_snapshots,
    "validate_snapshot_lines": q_validate_snapshot_lines,
    "snapshots_batch_scored": q_snapshots_batch_scored,
    "stream_scored": q_stream_scored,
    "stream_routed": q_stream_routed,
    "stream_quarantined": q_stream_quarantined,
    "stream_restarted": q_stream_restarted,
    "stream_live_status": q_stream_live_status,
    "stream_routed_by_table": q_stream_routed_by_table,
    "stream_archived": q_stream_archived,
    "canonical_tables": q_canonical_tables,
    "dataset_samples": q_dataset_samples,
    "dataset_test_samples": q_dataset_test_samples,
}

__all__ = ["QUERIES"]

"""The training / evaluation data set as one Spark plan, with the options of the original
data-set constructor (SURVEY 2.11 "user-facing options").

Order of the steps (it matters, SURVEY 2.11): F1 -> F2 -> F3 -> F4 -> J1 -> S4 -> F6 -> F7 ->
J2 -> E1 -> E2 -> A1/A2 -> W1 -> W2 -> E3/E4/A3 -> J5/J6 -> C1/C2 -> C3/C4 -> E5 or C6+C7 ->
E6 -> output.

Shuffle boundaries: (1) traces joined to the selected events (broadcast when the
catalogue is small, otherwise a skew-split sort-merge join), (2) the range partition of
``group_positions`` (a hot event is spread), (3) chunk 0 joined to its waveforms (unique
trace keys) and collected per event, (4) traces collected per chunk, (5) those of large
events are dealt by chunk bucket to meet their input set. All groups are bounded by ``max_station_num``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions.waveform import stored_position, stored_waveform, zero_samples
from quakeframe.operators import catalog as cat
from quakeframe.operators import traces as tr
from quakeframe.operators.balance import label_weights
from quakeframe.operators.masking import hidden_positions, hidden_waveforms, random_cutoff_sec, with_slot_mask
from quakeframe.operators.samples import hydrate_inputs, rank_traces, sample_id_col
from quakeframe.session import pinned


@dataclass
class DatasetOptions:
    sampling_rate: int = 200
    data_length_sec: int = 30
    test_year: int = 2018
    mode: str = "train"
    limit: int | None = None
    label_key: str = "pga"
    mask_waveform_sec: int | None = None
    mask_waveform_random: bool = False
    downsampling: bool = False
    oversample: float = 1.0
    oversample_mag: float = 4.0
    max_station_num: int = 25
    label_target: int = 25
    sort_by_picks: bool = True
    oversample_by_labels: bool = False
    mag_threshold: float = 0.0
    part_small_event: bool = False
    exact_small_sample: bool = False  # the exact fraction instead of a draw per event
    weight_label: bool = False
    station_blind: bool = False
    bias_to_closer_station: bool = False
    decimate: int = 1
    seed: str = "0"
    epoch: int = 0
    max_random_sec: int = 10
    check_catalog: bool = True
    waveform_col: str = "samples"     # which stored series feeds the model (input type)

    @property
    def length(self) -> int:
        return int(self.data_length_sec * self.sampling_rate)


def select_catalog(catalog: DataFrame, o: DatasetOptions) -> DataFrame:
    """F1-F4."""
    ev = cat.select_events(catalog, o.mag_threshold, o.part_small_event, o.test_year, seed=o.seed,
                           exact=o.exact_small_sample)
    ev = cat.split_by_year(ev, o.mode, o.test_year)
    return cat.first_events(ev, o.limit, "eq_id")


def sample_plan(catalog: DataFrame, traces: DataFrame, o: DatasetOptions, columns: list[str] | None = None) -> DataFrame:
    """Everything up to the ranked, chunked trace table (no waveforms yet); of the traces only ``columns``, if given."""
    if o.check_catalog:
        cat.assert_unique_events(catalog)
    ev = select_catalog(catalog, o).select("eq_id", "magnitude")
    t = tr.decimate_picks(traces, o.decimate)
    t = tr.valid_traces(t, o.label_key)
    if o.downsampling:
        t = tr.downsample_small(t, o.label_key, seed=o.seed)
    # Only traces of selected events; events left without traces drop out.
    t = t.join(ev, "eq_id")
    if o.oversample > 1:
        n = F.when(F.col("magnitude") >= o.oversample_mag, tr.event_copy_count(F.col("magnitude"), o.oversample))
        t = t.withColumn("n_copies", F.coalesce(n, F.lit(0)))
    else:
        t = t.withColumn("n_copies", F.lit(0))
    if columns:
        t = t.select(*columns, "n_copies")
    if o.weight_label:
        t = pinned(t, "labelled")               # counted, then weighted
        t = label_weights(t, o.label_key)       # before copies: copies inherit the weight (D8)
    if o.oversample_by_labels:
        t = tr.oversample_traces(t, o.label_key)
    if columns:
        t = t.drop("class")
    return rank_traces(t, o.max_station_num, o.sort_by_picks, pin=columns is None)


def collected(rows: DataFrame, by: list[str], **aggs) -> DataFrame:
    """``groupBy(*by).agg`` of bounded groups as a window: rows that a join has left in the order of ``by`` are not
    sorted again, nor is the result for a join on it; an aggregation sorts both once it has many groups."""
    w = Window.partitionBy(*by)
    out = rows.withColumn("_row", F.monotonically_increasing_id())
    out = out.select(*by, "_row", F.min("_row").over(w).alias("_lead"), *[a.over(w).alias(n) for n, a in aggs.items()])
    return out.filter(F.col("_row") == F.col("_lead")).drop("_row", "_lead")


def build_dataset(catalog: DataFrame, traces: DataFrame, waveforms: DataFrame, o: DatasetOptions,
                  chunks_per_bucket: int = 256) -> DataFrame:
    """One row per sample with the model inputs:

    ``waveform[max_station_num][T][3]``, ``sta[max_station_num][4]``, ``target[>=label_target][4]``,
    ``label[>=label_target]`` (+ ``weight`` when weighted, + ``eq_id``, ``p_picks``,
    ``label_time`` outside train mode), plus the sample key and the horizon used.

    Layout: chunk 0 of an event is collected once into an *input-set* row (at most
    ``max_station_num`` members; its waveforms fetched and cropped once per event); each chunk
    is collected into a *target-group* row. Every sample is one target group joined with its
    event's input set -- by event, and for an event of more chunks than a bucket holds by chunk bucket, so
    that a hot event's thousands of chunks spread over many tasks. Target rows are shuffled once, dealt as
    the join wants them; the input sets of normal events stay where they were collected. What differs between its copies (horizon, cut-off and slot mask) is
    drawn from narrow columns; each copy then takes one pass over the waveforms, all in generated
    code. No per-sample shuffle.
    """
    length = o.length
    lab = o.label_key
    ranked = sample_plan(catalog, traces, o, ["eq_id", "trace_idx", "p_pick", "lat", "lon", "elev", "vs30", lab, f"{lab}_time"])
    zero_pos = F.array_repeat(F.lit(0.0), 4)
    pos = F.array(*[F.col(c).cast("double") for c in ("lat", "lon", "elev", "vs30")]).alias("pos")
    member = [F.col("slot"), F.col("p_pick"), pos, F.col(lab).alias("label"),
              F.col(f"{lab}_time").alias("label_time"), F.col("trace_idx")]
    weight = ["weight"] if o.weight_label else []
    weight_aggs = {c: F.avg(c) for c in weight}

    # Input sets: chunk 0 with its waveforms (unique trace keys: no hot key in this join).
    # A trace without a stored waveform keeps its slot (and the reference pick) and is blanked.
    c0 = hydrate_inputs(ranked.filter(F.col("chunk_no") == 0), waveforms, o.waveform_col)
    c0_pos = stored_position("waveform", ("lat", "lon", "elev", "vs30")).alias("pos")
    # As a target (of a bias sample) the station keeps its position.
    c0_member = [*member, c0_pos.alias("input_pos"), stored_waveform("waveform", length).alias("waveform")]
    b = int(chunks_per_bucket)
    sets = collected(c0.select("eq_id", "n_chunks", F.struct(*c0_member).alias("_e"), *weight), ["eq_id"],
                     _m=F.collect_list("_e"), _k=F.max("n_chunks"), **{"_w0": a for a in weight_aggs.values()})
    sets = sets.withColumn("_m", F.sort_array("_m"))
    sets = sets.select(
        "eq_id", *(["_w0"] if weight else []),
        F.transform("_m", lambda e: e.dropFields("input_pos", "waveform")).alias("_t0"),
        F.col("_m.input_pos").alias("_pos"),
        F.transform("_m", lambda e: F.struct(e["slot"].alias("slot"), e["p_pick"].alias("p_pick"),
                                             F.exists(e["input_pos"], lambda x: x != 0).alias("real"))).alias("_st"),
        F.concat(F.col("_m.waveform"), F.array(zero_samples(length))).alias("_waves"), "_k")

    # Target groups, one per chunk (at most max_station_num members each), beside their event's input set.
    bucket = (F.col("chunk_no") / b).cast("int")

    def paired(rows, some_sets, by):
        rows = rows.withColumn("_bucket", bucket).repartition(*by)
        groups = collected(rows.select(*by, "chunk_no", "n_chunks", "n_copies", F.struct(*member).alias("_e"), *weight), [*by, "chunk_no"],
                           _t=F.collect_list("_e"), n_chunks=F.max("n_chunks"), n_copies=F.max("n_copies"), **weight_aggs)
        groups = groups.withColumn("_t", F.sort_array("_t"))
        return groups.join(some_sets.drop("_k"), by).drop("_bucket")

    salted = sets.filter(F.col("_k") > b).withColumn("_bucket", F.explode(F.sequence(F.lit(0), ((F.col("_k") - 1) / b).cast("int"))))
    s = (paired(ranked.filter(F.col("n_chunks") <= b), sets.filter(F.col("_k") <= b), ["eq_id"])
         .unionByName(paired(ranked.filter(F.col("n_chunks") > b), salted, ["eq_id", "_bucket"])))
    # Per event copy: horizon, cut-off and slot mask, from narrow columns, in generated code.
    n = F.col("n_copies") + 1
    kinds = F.when(F.col("n_chunks") > 1, 2).otherwise(1) if o.bias_to_closer_station else F.lit(1)
    s = s.withColumn("_copy", F.explode(F.sequence(F.lit(0), n * kinds - 1)))  # every copy, then every copy of the bias sample
    s = s.withColumn("event_copy", (F.col("_copy") % n).cast("int")).withColumn("is_bias", F.col("_copy") >= n).withColumn("sample_id", sample_id_col())
    if o.mask_waveform_random:
        sec = random_cutoff_sec(["sample_id"], o.mask_waveform_sec or 0, o.max_random_sec, o.epoch, o.seed)
    else:
        sec = F.lit(o.mask_waveform_sec).cast("int")
    masked = bool(o.mask_waveform_random or o.mask_waveform_sec)
    pick0 = F.get("_st", F.lit(0))["p_pick"]
    s = s.withColumn("mask_sec", sec).withColumn(
        "_cutoff", (pick0 + F.col("mask_sec") * int(o.sampling_rate)).cast("int") if masked else F.lit(None).cast("int"))
    s = with_slot_mask(s, "_st", F.col("_cutoff"), [F.col("sample_id")] if o.station_blind else None, o.max_station_num,
                       o.epoch, o.seed, "_hidden")
    # A bias sample's targets are chunk 0 itself (and its weight chunk 0's mean; D8).
    s = s.withColumn("_t", F.when(F.col("is_bias"), F.col("_t0")).otherwise(F.col("_t")))
    if o.weight_label:
        s = s.withColumn("weight", F.when(F.col("is_bias"), F.col("_w0")).otherwise(F.col("weight")))

    pad_t = F.greatest(F.lit(int(o.label_target)) - F.size("_t"), F.lit(0))
    cols = ["sample_id", "eq_id", "event_copy", "chunk_no", "is_bias", "mask_sec",
            hidden_waveforms("_waves", "_hidden", F.col("_cutoff"), o.max_station_num).alias("waveform"),
            hidden_positions("_pos", "_hidden", o.max_station_num).alias("sta"),
            F.concat(F.col("_t.pos"), F.array_repeat(zero_pos, pad_t)).alias("target"),
            F.concat(F.col("_t.label"), F.array_repeat(F.lit(0.0), pad_t)).alias("label")]
    if o.weight_label:
        cols.append("weight")
    if o.mode != "train":
        cols += [F.col("_t.p_pick").alias("p_picks"), F.col("_t.label_time").alias("label_time")]
    return s.select(*cols)


def dataset_summary(ds: DataFrame, weighted: bool | None = None) -> DataFrame:
    """Scalar summary of a built data set (what the oracle compares)."""
    real = lambda a: F.size(F.filter(F.col(a), lambda p: F.exists(p, lambda x: x != 0)))
    flat = F.flatten(F.flatten(F.col("waveform")))
    cols = ["sample_id", "event_copy", "chunk_no", "is_bias", "mask_sec",
            F.size("waveform").alias("n_inputs"), real("sta").alias("n_real_inputs"),
            F.size("target").alias("n_targets"), real("target").alias("n_real_targets"),
            F.round(F.greatest(F.array_max(flat), -F.array_min(flat)).cast("double"), 6).alias("peak"),
            F.round(F.aggregate("label", F.lit(0.0), lambda a, x: a + x), 6).alias("label_sum")]
    if weighted or (weighted is None and "weight" in ds.columns):
        cols.append(F.round(F.col("weight"), 9).alias("weight"))
    if "p_picks" in ds.columns:
        cols += [F.aggregate("p_picks", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("p_pick_sum"),
                 F.aggregate("label_time", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("label_time_sum")]
    return ds.select(*cols)

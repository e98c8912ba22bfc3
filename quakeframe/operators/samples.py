"""Sample plan: order an event's traces, cut them into station chunks, pair input and target
chunks, weight the samples, and attach trace attributes.

Layout of a sample (long form, one row per sample member)::

    sample key = (eq_id, event_copy, chunk_no, is_bias); side = 'input' | 'target'; slot

Inputs are always chunk 0 of the event (at most ``max_station_num`` rows per event), so
everything done on the input side is bounded per event. Targets are all traces and are
never grouped per event. The only fan-out -- copying chunk 0 into every sample of a
heavily chunked event -- is a join salted by chunk bucket, so a hot event is spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions.waveform import FLAT, crop, flat_waveform, whole_waveform
from quakeframe.operators.ranking import group_positions
from quakeframe.session import pinned

SAMPLE_KEY = ["eq_id", "event_copy", "chunk_no", "is_bias"]


def sample_id_col() -> "F.Column":
    return F.concat_ws("/", F.col("eq_id"), F.col("event_copy"), F.col("chunk_no"),
                       F.col("is_bias").cast("int"))


def rank_traces(traces: DataFrame, max_station_num: int = 25, sort_by_picks: bool = True,
                num_partitions: int | None = None, pin: bool = True) -> DataFrame:
    """W1 + W2: ``pos`` of each trace in its event, ``chunk_no``/``slot``, ``n_chunks`` and
    ``chunk_size`` (traces in this trace's chunk).

    Order by pick (ties: trace index, then copy; D10) or, when ``sort_by_picks`` is off, in
    stored order: original traces by index, then the over-sampled copies.

    The ranked table feeds several consumers (targets, chunk 0, the chunk spine); with
    ``pin`` it is written once as Parquet (shared checkpoint folder), so the ranking is
    computed once, consumers read only their columns, and later stages restart from it.
    """
    if "trace_copy" not in traces.columns:
        traces = traces.withColumn("trace_copy", F.lit(0))
    if sort_by_picks:
        order = [F.col("p_pick").asc_nulls_last(), F.col("trace_idx"), F.col("trace_copy")]
    else:
        order = [(F.col("trace_copy") > 0), F.col("trace_idx"), F.col("trace_copy")]
    ranked = group_positions(traces, ["eq_id"], order, pos_col="pos", size_col="n_traces",
                             num_partitions=num_partitions)
    m = int(max_station_num)
    ranked = (ranked
              .withColumn("n_traces", F.col("n_traces").cast("int"))
              .withColumn("chunk_no", (F.col("pos") / m).cast("int"))
              .withColumn("slot", (F.col("pos") % m).cast("int"))
              .withColumn("n_chunks", ((F.col("n_traces") + (m - 1)) / m).cast("int"))
              .withColumn("chunk_size", F.least(F.lit(m), F.col("n_traces") - F.col("chunk_no") * m).cast("int")))
    return pinned(ranked, "chunks") if pin else ranked


def build_samples(ranked: DataFrame, bias_to_closer_station: bool = False,
                  chunks_per_bucket: int = 256, copies_col: str | None = "n_copies",
                  inputs: DataFrame | None = None) -> DataFrame:
    """E3 (+E4): the long-form sample table.

    * one sample per chunk i: inputs = chunk 0, targets = chunk i (a single (all, all)
      sample when the event fits in one chunk);
    * with ``bias_to_closer_station``, every chunked event also gets, for each i, a sample
      (chunk 0, chunk 0) marked ``is_bias``;
    * with a ``copies_col`` (extra event copies from E1), every sample is repeated with
      ``event_copy`` 0..n.

    ``inputs`` optionally replaces the chunk-0 rows that are copied into every sample (for
    instance chunk 0 already joined with its waveforms: the wide column is then fetched once
    per event, not once per sample).
    """
    cols = [c for c in ranked.columns]
    payload = [c for c in cols if c not in ("chunk_no", "slot")]

    targets = ranked.select(
        *payload, "chunk_no", "slot",
        F.lit(False).alias("is_bias"), F.lit("target").alias("side"))

    # One spine row per (event, chunk); chunk-0 rows are copied to every spine row of their
    # event, for an event of many chunks through a join salted by bucket = chunk_no // chunks_per_bucket.
    b = int(chunks_per_bucket)
    spine = (ranked.filter(F.col("slot") == 0)
             .select("eq_id", F.col("chunk_no").alias("_sample_chunk"), F.col("n_chunks").alias("_n"),
                     (F.col("chunk_no") / b).cast("int").alias("_bucket")))
    chunk0 = inputs if inputs is not None else ranked.filter(F.col("chunk_no") == 0)
    chunk0 = chunk0.withColumn("_bucket", F.explode(F.sequence(F.lit(0), ((F.col("n_chunks") - 1) / b).cast("int"))))
    extra = [c for c in chunk0.columns if c not in cols and c != "_bucket"]
    # Inputs (perhaps with their waveforms) that lie by event stay there; only those of events of
    # several buckets are dealt anew, by bucket.
    normal = chunk0.filter(F.col("n_chunks") <= b).drop("_bucket").join(spine.filter(F.col("_n") <= b).select("eq_id", "_sample_chunk"), "eq_id")
    dealt = chunk0.filter(F.col("n_chunks") > b).join(spine.filter(F.col("_n") > b).drop("_n"), ["eq_id", "_bucket"]).drop("_bucket")
    copied = normal.unionByName(dealt)

    roles = F.array(F.struct(F.lit("input").alias("side"), F.lit(False).alias("is_bias")))
    if bias_to_closer_station:
        roles = F.when(F.col("n_chunks") > 1, F.array(
            F.struct(F.lit("input").alias("side"), F.lit(False).alias("is_bias")),
            F.struct(F.lit("input").alias("side"), F.lit(True).alias("is_bias")),
            F.struct(F.lit("target").alias("side"), F.lit(True).alias("is_bias")),
        )).otherwise(roles)
    copied = (copied.withColumn("_role", F.explode(roles))
              .select(*payload, *extra, F.col("_sample_chunk").alias("chunk_no"), "slot",
                      F.col("_role.is_bias").alias("is_bias"), F.col("_role.side").alias("side")))
    samples = targets.unionByName(copied, allowMissingColumns=bool(extra))
    if copies_col and copies_col in cols:
        samples = samples.withColumn("event_copy", F.explode(F.sequence(F.lit(0), F.col(copies_col))))
    else:
        samples = samples.withColumn("event_copy", F.lit(0))
    return samples.withColumn("sample_id", sample_id_col())


def sample_weights(samples: DataFrame, weight_col: str = "weight") -> DataFrame:
    """A3: sample weight = mean weight of its target rows (a bias sample therefore gets the
    mean of chunk 0; D8). A map-side-combined aggregation, safe for hot events."""
    return (samples.filter(F.col("side") == "target")
            .groupBy(*SAMPLE_KEY, "sample_id")
            .agg(F.avg(weight_col).alias("weight"), F.count(F.lit(1)).alias("n_targets")))


def input_traces(ranked: DataFrame) -> DataFrame:
    """Chunk 0 of every event (the input set shared by all its samples), with the
    reference pick ``pick0`` = pick of slot 0 (W3). The window here holds at most
    ``max_station_num`` rows."""
    inputs = ranked.filter(F.col("chunk_no") == 0)
    w = Window.partitionBy("eq_id").orderBy("slot")
    return inputs.withColumn("pick0", F.first("p_pick").over(w))


def hydrate_inputs(inputs: DataFrame, waveforms: DataFrame, wave_col: str = "samples", flag: bool = False,
                   length: int | None = None) -> DataFrame:
    """Attach the waveform to input traces. The key (eq_id, trace_idx) is unique per
    trace, so this join has no hot key. A trace without a stored waveform keeps its slot with
    a NULL waveform, which every later step treats as a blanked station; ``missing_waveforms``
    lists these traces.

    The waveforms are first cut to the inputs' keys (a semi join, which Spark moves below the
    joins that build them), so that those of other traces are neither built nor shuffled. The inputs are
    at most a chunk per event, so the only equality of both joins is the event's, with the trace as a
    filter: what lies by event is not shuffled again, nor are the samples for a step that collects an event's inputs. With
    ``flag``, ``has_waveform`` says beside the waveform whether one is stored: a consumer that
    only asks this reads and shuffles no samples. With ``length`` the wanted waveforms are cropped
    to it (C1) before they are shuffled. They travel as one array of values, not as an array per sample."""
    key = ["eq_id", "trace_idx"]
    has = [F.col(wave_col).isNotNull().alias("has_waveform")] if flag else []
    wanted = inputs.select(*[F.col(k).alias(f"_{k}") for k in key])
    same = (F.col("trace_idx") <= F.col("_trace_idx")) & (F.col("trace_idx") >= F.col("_trace_idx"))
    w = waveforms.select(*key, F.col(wave_col).alias("waveform"), *has).join(wanted, (F.col("eq_id") == F.col("_eq_id")) & same, "left_semi")
    if length is not None:
        w = w.withColumn("waveform", crop("waveform", length))
    w = w.select(*[F.col(k).alias(f"_{k}") for k in key], *flat_waveform("waveform"), *(["has_waveform"] if flag else []))
    out = inputs.join(w, (F.col("eq_id") == F.col("_eq_id")) & same, "left").drop("_eq_id", "_trace_idx")
    out = out.withColumn("waveform", whole_waveform()).drop(*FLAT)
    out = out.select(*key, *[c for c in out.columns if c not in (*key, "waveform", "has_waveform")], "waveform", *(["has_waveform"] if flag else []))
    return out.withColumn("has_waveform", F.coalesce("has_waveform", F.lit(False))) if flag else out


def kept_samples(ranked: DataFrame, sec: int, rate: int, length: int) -> int:
    """The most samples that a cut-off ``sec`` seconds after the reference pick leaves in any input set (C6), ``length`` at
    most: what lies behind is zeroed for every event, and need not travel with the waveforms. One pass over the
    first rows of the events; a set without a pick keeps all."""
    first = ranked.filter((F.col("chunk_no") == 0) & (F.col("slot") == 0))
    far, blank = first.agg(F.max("p_pick"), F.count(F.when(F.col("p_pick").isNull(), 1))).first()
    return int(length) if blank or far is None or not sec else max(0, min(int(length), int(far) + int(sec) * int(rate)))


def missing_waveforms(inputs: DataFrame, waveforms: DataFrame) -> DataFrame:
    """The input traces for which no waveform is stored (only keys are shuffled)."""
    return inputs.join(waveforms.select("eq_id", "trace_idx"), ["eq_id", "trace_idx"], "left_anti")


def hydrate_targets(samples: DataFrame, label: str = "pga") -> DataFrame:
    """J6 + C5: target rows with position, Vs30 (``target_pos`` = [lat, lon, elev, vs30]),
    label, pick and label time."""
    t = samples.filter(F.col("side") == "target")
    return t.select(*SAMPLE_KEY, "sample_id", "slot", "trace_idx", "trace_copy",
                    F.array("lat", "lon", "elev", "vs30").alias("target_pos"),
                    F.col(label).alias("label"), "p_pick", F.col(f"{label}_time").alias("label_time"))

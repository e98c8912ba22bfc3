"""Hydration builds and moves only the waveforms that are asked for, with the same rows as before."""

from datetime import datetime

from pyspark.sql import functions as F

from quakeframe.operators.masking import apply_cutoff
from quakeframe.operators.samples import hydrate_inputs
from quakeframe.operators.snapshots import event_traces
from quakeframe.sources import fixtures as fx

TRACE = "eq_id long, trace_idx int, slot int, p_pick int, pick0 int, lat double, lon double, elev double, vs30 double"


def _waveforms(spark, path):
    """Two events of two traces, of which event 2 has one vector, and a trace without an event."""
    lines = [(1, 10, 1), (1, 11, 2), (2, 12, 1), (2, 13, 2), (None, 14, 1)]
    spark.createDataFrame([(o, p, 1, n, 1.0, datetime(2000, 1, 1)) for o, p, n in lines],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp"
                          ).write.parquet(f"{path}/lineitem.parquet")
    # vec_id = (7 * eq_id + trace_idx) % (14 + 4): 7, 8, 14, 15
    spark.createDataFrame([(7, [1.0]), (8, [4.0]), (8, [7.0]), (14, [9.0])], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return fx.fx_waveforms(spark, str(path))


def _depths(df, *words):
    """For each word the depth of its first line in the optimized plan."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    out = []
    for word in words:
        line = next(x for x in lines if word in x)
        out.append(len(line) - len(line.lstrip(" :+-")))
    return out


def test_hydrate_inputs_cuts_the_waveforms_before_they_are_built(spark, tmp_path):
    rows = [(e, t, s, 1, 1, 1.0, 1.0, 1.0, 1.0) for e, t, s in [(1, 0, 0), (1, 1, 1), (1, 1, 2), (2, 0, 0), (2, 1, 1), (None, 0, 0)]]
    h = hydrate_inputs(spark.createDataFrame(rows, TRACE), _waveforms(spark, tmp_path), flag=True)
    got = sorted((r["eq_id"] or -1, r["slot"], r["waveform"][0][0] if r["waveform"] else 0, r["has_waveform"]) for r in h.collect())
    assert got == [(-1, 0, 0, False), (1, 0, 1.0, True), (1, 1, 4.0, True), (1, 1, 7.0, True), (1, 2, 4.0, True), (1, 2, 7.0, True),
                   (2, 0, 9.0, True), (2, 1, 0, False)]
    semi, inner = _depths(h, "Join LeftSemi", "Join Inner")
    assert semi > inner  # below the join that builds the samples


def test_blanked_alone_reads_no_samples(spark):
    rows = [(1, 0, 0, 1, 1, 1.0, 1.0, 1.0, 1.0), (2, 0, 0, 1, 1, 1.0, 1.0, 1.0, 1.0), (1, 1, 1, 9, 1, 1.0, 1.0, 1.0, 1.0)]
    inputs = spark.createDataFrame(rows, TRACE)
    stored = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0])], "eq_id long, trace_idx int, x array<float>")
    waveforms = stored.select("eq_id", "trace_idx", F.array("x").alias("samples"))
    m = apply_cutoff(hydrate_inputs(inputs, waveforms, flag=True), 3, 2, 4).select("eq_id", "slot", "blanked", "lat")
    assert sorted(tuple(r) for r in m.collect()) == [(1, 0, False, 1.0), (1, 1, True, 0.0), (2, 0, True, 0.0)]
    assert "array(x#" not in m._jdf.queryExecution().optimizedPlan().toString()


def test_replay_cuts_the_waveforms_before_they_are_built(spark, tmp_path):
    ids = spark.createDataFrame([(1,), (1,)], "eq_id long")
    traces = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "eq_id long, trace_idx int")
    t = event_traces(ids, traces, _waveforms(spark, tmp_path), 1)
    assert sorted(r["waveform"][0][0] for r in t.collect()) == [1.0, 4.0, 7.0]
    plan = t._jdf.queryExecution().optimizedPlan().toString().splitlines()
    inner = next(i for i, x in enumerate(plan) if "Join Inner" in x)
    assert any("Join LeftSemi" in x for x in plan[inner:])

"""Waveforms cross one shuffle on their way into an event's input set, and only those of the wanted events."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from quakeframe.operators.samples import hydrate_inputs
from quakeframe.operators.snapshots import ladder_snapshots
from quakeframe.sources import fixtures as fx
from quakeframe.sources.snapshots_io import read_predictions, read_snapshots, write_predictions, write_snapshots


def _between(df, top, bottom):
    """The lines of the physical plan from the first with ``top`` to the next with ``bottom``."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    a = next(i for i, x in enumerate(lines) if top in x)
    b = next(i for i, x in enumerate(lines) if i > a and bottom in x)
    return "\n".join(lines[a:b])


def _shuffled_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return old


def test_hydrated_inputs_are_collected_without_another_shuffle(spark):
    old = _shuffled_joins(spark)
    try:
        inputs = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 1, 2), (2, 0, 0), (3, None, 0), (None, 0, 0)], "eq_id long, trace_idx int, slot int")
        stored = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0]), (1, 1, [3.0]), (1, 9, [4.0]), (3, None, [5.0]), (None, 0, [6.0])],
                                       "eq_id long, trace_idx int, x array<float>")
        h = hydrate_inputs(inputs, stored.select("eq_id", "trace_idx", F.array("x").alias("samples")))
        assert h.columns == ["eq_id", "trace_idx", "slot", "waveform"]
        got = sorted((r["eq_id"] or -1, r["slot"], r["waveform"][0][0] if r["waveform"] else 0) for r in h.collect())
        assert got == [(-1, 0, 0), (1, 0, 1.0), (1, 1, 2.0), (1, 1, 3.0), (1, 2, 2.0), (1, 2, 3.0), (2, 0, 0), (3, 0, 0)]
        sets = h.groupBy("eq_id").agg(F.collect_list("waveform").alias("w"))
        assert "Exchange" not in _between(sets, "ObjectHashAggregate", "SortMergeJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_ladder_snapshots_crop_and_collect_without_another_shuffle(spark):
    old = _shuffled_joins(spark)
    try:
        ids = spark.createDataFrame([(1,), (1,), (2,)], "eq_id long")
        traces = spark.createDataFrame([(1, 0, 1), (1, 1, 9), (2, 0, 1), (4, 0, 1)], "eq_id long, trace_idx int, p_pick int")
        traces = traces.select("*", *[F.lit(1.0).alias(c) for c in ("lat", "lon", "elev", "vs30")])
        w = spark.createDataFrame([(1, 0, 3.0), (1, 1, 4.0), (4, 0, 5.0)], "eq_id long, trace_idx int, x float")
        w = w.select("eq_id", "trace_idx", F.array_repeat(F.array("x", "x", "x"), 5).alias("samples"))
        s = ladder_snapshots(traces, w, ids, secs=[1, 9], rate=1, length=3, max_station_num=2)
        got = sorted((r["eq_id"], r["mask_sec"], [[x[0] for x in t] for t in r["waveform"]]) for r in s.collect())
        z = [0.0] * 3
        assert got == [(1, 1, [[3.0, 3.0, 0.0], z]), (1, 9, [[3.0] * 3, [4.0] * 3]), (2, 1, [z, z]), (2, 9, [z, z])]
        assert "Exchange" not in _between(s.select("*"), "ObjectHashAggregate", "SortMergeJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_lines_of_other_events_are_dropped_before_the_numbering(spark, tmp_path):
    lines = [(1, 2, 1), (1, 1, 1), (2, 1, 1), (None, 1, 1), (3, 1, 2)]
    spark.createDataFrame([(o, 10, s, n, 1.0, datetime(2000, 1, 1), 2.0, 0.1, 0.1) for o, n, s in lines],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp, "
                          "l_quantity double, l_tax double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, "b")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, [float(i)]) for i in range(30)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    ids = spark.createDataFrame([(1,), (1,), (3,), (None,)], "eq_id long")
    old = _shuffled_joins(spark)
    try:
        for whole, some in ((fx.fx_traces(spark, str(tmp_path)), fx.fx_traces(spark, str(tmp_path), events=ids)),
                            (fx.fx_waveforms(spark, str(tmp_path)), fx.fx_waveforms(spark, str(tmp_path), ids))):
            assert sorted(map(str, some.collect())) == sorted(map(str, whole.join(ids, "eq_id", "left_semi").collect()))
            plan = some._jdf.queryExecution().optimizedPlan().toString()
            assert plan.index("Window") < plan.index("Join LeftSemi")  # below it
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _names(path):
    return [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]


def test_packed_snapshots_and_predictions_read_back(spark, tmp_path):
    rows = [(1, 3, datetime(2000, 1, 1), [[[1.0, 2.0, 0.1]]], [[1.0, 2.0, 3.0]]), (2, 5, None, [[[0.5, 0.0, 0.0]]], [[4.0, 5.0, 6.0]])]
    snaps = spark.createDataFrame(rows, "eq_id long, mask_sec int, event_time timestamp, waveform array<array<array<float>>>, station array<array<float>>")
    preds = spark.createDataFrame([("a", "1/0/0/0", 0, 1, 0.1), ("b", "1/0/0/0", 1, 1, None)], "model string, sample_id string, slot int, eq_id long, predict double")
    back = []
    for kind in (None, "gzip"):
        s, p = f"{tmp_path}/s-{kind}", f"{tmp_path}/p-{kind}"
        write_snapshots(snaps, s, partition_by=None, compression=kind)
        write_predictions(preds, p, compression=kind)
        assert all(f.endswith(".gz") == (kind == "gzip") for f in _names(s) + _names(p))
        # CSVs written without some columns are read by position: compared with each other only
        back.append((sorted(map(str, read_snapshots(spark, s).collect())), sorted(map(str, read_predictions(spark, p).select("model").collect()))))
    assert back[0] == back[1] and len(back[0][0]) == 2 and len(back[0][1]) == 2

"""What ranking, hydration and copying shuffle: ranked rows once, samples as one array, inputs copied where they lie."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quakeframe.functions.waveform import FLAT, flat_waveform, whole_waveform
from quakeframe.operators.masking import apply_cutoff
from quakeframe.operators.ranking import group_positions
from quakeframe.operators.samples import build_samples, hydrate_inputs, input_traces, kept_samples, rank_traces
from quakeframe.sources import fixtures as fx


@pytest.fixture()
def shuffled(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _plan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("Initial Plan"):] if "Initial Plan" in plan else plan


TRACE = "eq_id long, trace_idx int, p_pick int, lat double, lon double, elev double, vs30 double"


def _traces(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 2.0, 3.0, 4.0) for r in rows], TRACE)


def _waves(spark, rows):
    w = spark.createDataFrame(rows, "eq_id long, trace_idx int, x float")
    return w.select("eq_id", "trace_idx", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.array(*[F.col("x") * i] * 3)).alias("samples"))


def test_positions_shuffle_nothing_after_the_ranges(shuffled):
    rows = [(k, i, (i * 7) % 11) for k in (None, 1, 2, 3) for i in range(400 if k == 2 else 5)] + [(1, 0, 0)] * 3
    df = shuffled.createDataFrame(rows, "eq_id long, trace_idx int, p_pick int").repartition(5)
    got = group_positions(df, ["eq_id"], ["p_pick", "trace_idx"], num_partitions=7, pos_type="long")
    assert got.columns == ["eq_id", "trace_idx", "p_pick", "group_size", "pos"] and dict(got.dtypes)["pos"] == "bigint"
    w = Window.partitionBy("eq_id")
    want = df.select("*", F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("p_pick", "trace_idx")) - 1)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    plan = _plan(got)
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_flat_waveforms_come_back_whole(spark):
    three, one = [[1.0, 2.0, 3.0], [4.0, None, 6.0]], [[1.0], [2.0], [3.0]]
    waves = [three, one, [], None, [[]], [[1.0], [1.0, 2.0]], [[1.0], None], [None], [[], []], [[1.0, 2.0]]]
    df = spark.createDataFrame(list(enumerate(waves)), "i int, w array<array<float>>").select("i", *flat_waveform("w"))
    back = {r["i"]: r["w"] for r in df.select("i", whole_waveform().alias("w")).collect()}
    assert [back[i] for i in range(len(waves))] == waves
    assert [r["i"] for r in df.filter(F.col(FLAT[0]).isNull()).sort("i").collect()] == [3, 4, 5, 6, 7, 8]


def test_what_every_mask_zeroes_does_not_travel(shuffled):
    traces = _traces(shuffled, [(1, 0, 1), (1, 1, 2), (1, 2, 9), (2, 0, 2), (3, 0, 1)])
    ranked = rank_traces(traces, max_station_num=2)
    waves = _waves(shuffled, [(1, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0), (2, 0, 4.0)])
    assert kept_samples(ranked, 1, 2, 6) == 4 and kept_samples(ranked, 9, 2, 6) == 6 and kept_samples(ranked, 0, 2, 6) == 6
    assert kept_samples(ranked.filter("eq_id > 9"), 1, 2, 6) == 6
    late = rank_traces(_traces(shuffled, [(1, 0, -9), (2, 0, None)]), 2)
    assert kept_samples(late, 1, 2, 6) == 6 and kept_samples(late.filter("eq_id = 1"), 1, 2, 6) == 0
    inputs = input_traces(ranked)
    some = apply_cutoff(hydrate_inputs(inputs, waves, flag=True, length=4), 1, 2, 6)
    whole = apply_cutoff(hydrate_inputs(inputs, waves, flag=True), 1, 2, 6)
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.collect())) and whole.count() == 5


def test_inputs_are_copied_without_another_shuffle(shuffled):
    traces = _traces(shuffled, [(1, i, i) for i in range(7)] + [(2, 0, 1), (None, 0, 1), (None, 1, 2)])
    ranked = rank_traces(traces, max_station_num=2)
    waves = _waves(shuffled, [(1, 0, 1.0), (2, 0, 3.0)])
    c0 = hydrate_inputs(ranked.filter("chunk_no = 0"), waves)
    samples = [build_samples(ranked, inputs=c0, chunks_per_bucket=b).filter("side = 'input'") for b in (1, 2, 256)]
    got = [sorted((r["eq_id"], r["chunk_no"], r["slot"], r["waveform"][0][0] if r["waveform"] else None) for r in s.collect()) for s in samples]
    assert got[0] == got[1] == got[2] == [(1, c, s, None if s else 1.0) for c in range(4) for s in (0, 1)] + [(2, 0, 0, 3.0)]
    assert all("_flat" not in line or "_bucket" not in line for line in _plan(samples[2]).splitlines() if "Exchange hashpartitioning(eq_id" in line)
    lines = _plan(samples[2]).splitlines()
    copy = next(i for i, x in enumerate(lines) if "SortMergeJoin [eq_id" in x and "Inner" in x)
    wave = next(i for i, x in enumerate(lines) if i > copy and "SortMergeJoin" in x and "LeftOuter" in x)
    assert not any("Exchange" in x for x in lines[copy:wave])


def test_traces_lie_by_event_and_only_counts_make_the_keys_of_waveforms(shuffled, tmp_path):
    lines = [(1, 2, 1, 0.0), (1, 1, 2, 0.1), (1, 1, 2, 0.1), (2, 1, 1, 0.1), (3, None, 9, 0.1), (None, 1, 1, 0.1), (None, 1, 2, 0.1)]
    shuffled.createDataFrame([(o, n, s, 10, 1.0, None, 2.0, t, t) for o, n, s, t in lines],
                             "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double, l_shipdate timestamp, "
                             "l_quantity double, l_tax double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    shuffled.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    shuffled.createDataFrame([(i, [float(i)]) for i in range(30)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    keys = fx.fx_trace_vectors(shuffled, str(tmp_path)).select("eq_id", "trace_idx")
    numbered = fx.numbered_lines(shuffled, str(tmp_path)).select("l_orderkey", "trace_idx")
    assert keys.schema["trace_idx"].dataType == numbered.schema["trace_idx"].dataType
    assert sorted(map(str, map(tuple, keys.collect()))) == sorted(map(str, map(tuple, numbered.collect())))
    assert "l_linenumber" not in _plan(keys)
    traces = fx.fx_traces(shuffled, str(tmp_path))
    few, fx.BROADCAST_STATIONS = fx.BROADCAST_STATIONS, 1
    try:
        joined = fx.fx_traces(shuffled, str(tmp_path))
        assert "BroadcastHashJoin" not in _plan(joined)
    finally:
        fx.BROADCAST_STATIONS = few
    assert sorted(map(str, traces.collect())) == sorted(map(str, joined.collect())) and traces.count() == 9
    by_event = _plan(traces.join(shuffled.createDataFrame([(1,)], "eq_id long"), "eq_id"))
    assert by_event.count("Exchange hashpartitioning") == 2  # the lines to their order, and the events

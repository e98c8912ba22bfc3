"""What the replay snapshots shuffle and sort: lines once, times beside narrow rows, samples once."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quakeframe.operators.snapshots import ladder_snapshots
from quakeframe.plans import queries
from quakeframe.session import pinned
from quakeframe.sources import fixtures as fx

ORDER, LINE = "o_orderkey long, o_orderdate timestamp, o_totalprice double", (
    "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double, l_shipdate timestamp, "
    "l_quantity double, l_tax double, l_discount double")


@pytest.fixture()
def shuffled(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture()
def tables(spark, tmp_path):
    """Events 1 (twice in orders) and 3 of the replay year, 2 of another; lines with nulls and copies."""
    year = datetime(fx.TEST_YEAR, 5, 1)
    spark.createDataFrame([(1, year, 1e5), (1, year, 1e5), (2, datetime(1999, 1, 1), 1e5), (3, year, 2e5)], ORDER).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 2, 1, 0.0), (1, 1, 2, 0.1), (1, 1, 2, 0.1), (2, 1, 1, 0.1), (3, 1, 2, None), (3, None, 9, 0.1), (None, 1, 1, 0.1)]
    spark.createDataFrame([(o, n, s, 10, 1.0, year, 2.0, t, t) for o, n, s, t in lines], LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, [float(i)]) for i in range(30)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_kept_lines_give_the_same_traces_and_waveforms(shuffled, tables):
    ids = shuffled.createDataFrame([(1,), (3,), (None,)], "eq_id long")
    lines = pinned(fx.numbered_lines(shuffled, tables, ids).select(*fx.LINE_COLUMNS), "lines")
    for kept, own in ((fx.fx_traces(shuffled, tables, lines=lines), fx.fx_traces(shuffled, tables, events=ids)),
                      (fx.fx_waveforms(shuffled, tables, lines=lines), fx.fx_waveforms(shuffled, tables, ids))):
        rows = sorted(map(str, kept.collect()))
        assert rows == sorted(map(str, own.collect())) and len(rows) >= 5
        assert "l_shipdate" not in kept._jdf.queryExecution().optimizedPlan().toString()  # numbered before


def test_snapshots_number_the_lines_once(shuffled, tables):
    s = queries._snapshots(shuffled, tables)
    assert not any("lineitem.parquet" in f for f in s.inputFiles())
    got = sorted((r["eq_id"], r["mask_sec"], len(r["waveform"])) for r in s.collect())
    assert [g[:2] for g in got] == [(e, m) for e, n in ((1, 2), (3, 1)) for m in (3, 5, 7, 10) for _ in range(n)]


def test_times_are_joined_before_the_stations_are_collected(shuffled):
    ids = shuffled.createDataFrame([(1,), (2,), (3,)], "eq_id long")
    traces = shuffled.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 0, 1)], "eq_id long, trace_idx int, p_pick int")
    traces = traces.select("*", *[F.lit(1.0).alias(c) for c in ("lat", "lon", "elev", "vs30")])
    w = shuffled.createDataFrame([(1, 0, 3.0), (2, 0, 4.0)], "eq_id long, trace_idx int, x float")
    w = w.select("eq_id", "trace_idx", F.array_repeat(F.array("x", "x", "x"), 2).alias("samples"))
    a, b = datetime(2000, 1, 1), datetime(2000, 1, 2)
    times = shuffled.createDataFrame([(1, a), (1, a), (1, b), (2, None), (None, b)], "eq_id long, event_time timestamp")
    s = ladder_snapshots(traces, w, ids, secs=[1], rate=1, length=2, max_station_num=1, event_time=times)
    assert s.columns == ["eq_id", "mask_sec", "event_time", "waveform", "station"]
    assert sorted((r["eq_id"], str(r["event_time"])) for r in s.collect()) == [
        (1, str(a)), (1, str(a)), (1, str(b)), (2, "None"), (3, "None")]
    plan = s._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Initial Plan"):] if "Initial Plan" in plan else plan
    assert "Join" not in plan[:plan.index("ObjectHashAggregate")]  # no wide row is sorted for its time

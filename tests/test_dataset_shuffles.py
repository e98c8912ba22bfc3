"""The data set's input sets stay where they were collected, unsorted, whatever an event's number of chunks."""

import pytest
from pyspark.sql import functions as F

from quakeframe.plans.dataset import DatasetOptions, build_dataset, collected


@pytest.fixture()
def shuffled(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _above(df, word):
    """The operators above the first sort-merge join of kind ``word`` in the physical plan as first planned, nearest first."""
    lines = df.select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    at = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x and word in x)
    out, d = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < d:
            out.append(x.strip(" :+-"))
            d = depth(x)
    return out


def test_input_sets_are_neither_moved_nor_sorted_again(shuffled):
    events = shuffled.createDataFrame([(1, 2000, 5.0), (2, 2000, 3.0), (3, 2000, 4.0)], "eq_id long, year int, magnitude double")
    rows = [(1, i, i % 4, 0.1 * i) for i in range(11)] + [(2, 0, 1, 0.5), (2, 1, 1, -2.0), (4, 0, 1, 0.5)]
    traces = shuffled.createDataFrame(rows, "eq_id long, trace_idx int, p_pick int, pga double")
    traces = traces.select("*", *[F.lit(float(i)).alias(c) for i, c in enumerate(("lat", "lon", "elev", "vs30"))], F.lit(7).alias("pga_time"))
    waves = shuffled.createDataFrame([(1, 0, 1.0), (1, 4, 2.0), (2, 0, 3.0), (2, 0, 4.0)], "eq_id long, trace_idx int, x float")
    waves = waves.select("eq_id", "trace_idx", F.array_repeat(F.array("x", "x", "x"), 5).alias("samples"))
    o = DatasetOptions(sampling_rate=1, data_length_sec=4, mode="all", mask_waveform_sec=2, mask_waveform_random=True, max_station_num=2, label_target=2,
                       oversample=1.5, oversample_by_labels=True, weight_label=True, station_blind=True, bias_to_closer_station=True)
    built = {b: build_dataset(events, traces, waves, o, b) for b in (1, 2, 256)}
    got = {b: sorted(map(str, ds.collect())) for b, ds in built.items()}
    assert got[1] == got[2] == got[256]
    ids = [r["sample_id"] for r in built[256].select("sample_id").collect()]
    assert len(ids) == len(set(ids)) == built[256].select("eq_id", "event_copy", "chunk_no", "is_bias").distinct().count()
    assert built[256].filter("is_bias").select("eq_id").distinct().count() == 2
    above = _above(built[256], "LeftOuter")  # the events of one bucket come first
    join = next(i for i, x in enumerate(above) if "SortMergeJoin" in x and "Inner" in x)
    found = [x[:90] for x in above[:join] if any(word in x for word in ("Exchange", "Sort ", "ObjectHashAggregate"))]
    assert not found, [x[:90] for x in above[:join]]


def test_collected_is_a_group_by(spark):
    rows = [(k, i) for k in (None, 1, 2) for i in range(3)] + [(1, 0)]
    df = spark.createDataFrame(rows, "k long, i int")
    got = collected(df, ["k"], n=F.count("i"), top=F.max("i"), all=F.collect_list("i"))
    want = df.groupBy("k").agg(F.count("i").alias("n"), F.max("i").alias("top"), F.collect_list("i").alias("all"))
    rows = [sorted((str(r["k"]), r["n"], r["top"], sorted(r["all"])) for r in d.collect()) for d in (got, want)]
    assert got.columns == want.columns and rows[0] == rows[1] and len(rows[0]) == 3
    assert collected(df.limit(0), ["k"], n=F.count("i")).count() == 0

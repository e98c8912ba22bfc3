"""Worked values of SURVEY 2.13 for intensity classes, ticks, copies and thresholds."""

import math

import pytest
from pyspark.sql import functions as F

from quakeframe.functions.intensity import intensity8, intensity10, intensity_label, scale_table
from quakeframe.operators.balance import class_histogram, label_weights
from quakeframe.operators.traces import (downsample_small, event_copy_count, explode_event_groups,
                                         oversample_events, oversample_traces, trace_copy_count, valid_traces)


def _one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} double" for n in names))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("pga, label", [(0.25, "4"), (0.79, "4"), (0.8, "5-"), (0.9, "5-"), (9, "7"), (1e-6, "0")])
def test_intensity10_pga_only(spark, pga, label):
    c = intensity10("pga")
    assert _one(spark, intensity_label(c), pga=math.log10(pga)) == label


@pytest.mark.parametrize("pga, pgv, label", [(0.8, 1.0, "5-"), (0.9, 1.0, "6+"), (0.9, 0.1, "5-")])
def test_intensity10_pgv_escalation(spark, pga, pgv, label):
    c = intensity10("pga", "pgv")
    assert _one(spark, intensity_label(c), pga=math.log10(pga), pgv=math.log10(pgv)) == label


def test_intensity_nan_is_null(spark):
    assert _one(spark, intensity10("pga"), pga=float("nan")) is None
    assert _one(spark, intensity8("pga"), pga=float("nan")) is None


def test_intensity8_bounds_inclusive(spark):
    assert _one(spark, intensity8("pga"), pga=math.log10(0.008)) == 1
    assert _one(spark, intensity8("pga"), pga=math.log10(0.0079)) == 0
    assert _one(spark, intensity8("pga"), pga=math.log10(8)) == 7


def test_ticks(spark):
    rows = {(r.target, r["class"]): r.tick for r in scale_table(spark).collect()}
    pga = [-3.548455, -1.849485, -1.349485, -0.849485, -0.349485, 0.024609, 0.272034, 0.520696, 0.773271, 1.025846]
    pgv = [-3.849485, -2.426936, -1.938074, -1.482686, -1.034017, -0.673394, -0.411954, -0.198970, 0.024609,
           0.248188]
    for i in range(10):
        assert rows[("pga", i)] == pytest.approx(pga[i], abs=1e-6)
        assert rows[("pgv", i)] == pytest.approx(pgv[i], abs=1e-6)


@pytest.mark.parametrize("over, mag, n", [(1.5, 4.0, 2), (1.5, 5.0, 4), (1.5, 6.5, 8), (2, 4.0, 7), (2, 5.5, 21),
                                          (1.1, 4.0, 0)])
def test_event_copies(spark, over, mag, n):
    assert _one(spark, event_copy_count(F.col("m"), over), m=mag) == n


def test_event_copies_below_threshold_and_nan(spark):
    df = spark.createDataFrame([(1, 3.99), (2, float("nan")), (3, 4.0)], "eq_id long, magnitude double")
    out = {r.eq_id: r.n for r in oversample_events(df, 1.5, 4.0).groupBy("eq_id").agg(F.count("*").alias("n")).collect()}
    assert out == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("label, n", [(-1.24, 3), (-1.0, 4), (-0.5, 4), (0.0, 6), (0.5, 7), (0.9, 10)])
def test_trace_copies(spark, label, n):
    assert _one(spark, trace_copy_count(F.col("l")), l=label) == n


def test_trace_copies_rows(spark):
    df = spark.createDataFrame([(1, 0, -1.25), (1, 1, 0.0)], "eq_id long, trace_idx int, pga double")
    out = sorted((r.trace_idx, r.trace_copy) for r in oversample_traces(df).collect())
    assert out == [(0, 0)] + [(1, k) for k in range(7)]


def test_valid_traces_keeps_zero_key_and_zero_label(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (0, 1, float("nan")), (1, 0, None)], "eq_id long, trace_idx int, pga double")
    assert [(r.eq_id, r.trace_idx) for r in valid_traces(df).collect()] == [(0, 0)]


def test_downsample_only_below_threshold(spark):
    rows = [(i, 0, -1.7212) for i in range(200)] + [(1000 + i, 0, -1.7213) for i in range(200)]
    df = spark.createDataFrame(rows, "eq_id long, trace_idx int, pga double")
    kept = downsample_small(df, "pga")
    above = kept.filter(F.col("eq_id") < 1000).count()
    below = kept.filter(F.col("eq_id") >= 1000).count()
    assert above == 200          # log10(0.019) = -1.721246: -1.7212 is not below
    assert 60 < below < 140      # about half dropped, deterministically
    assert below == downsample_small(df, "pga").filter(F.col("eq_id") >= 1000).count()


def test_weights_and_histogram(spark):
    df = spark.createDataFrame([(1, 0, math.log10(0.9)), (1, 1, math.log10(0.9)), (1, 2, math.log10(3.0))],
                               "eq_id long, trace_idx int, pga double")
    w = sorted((r.trace_idx, r.weight) for r in label_weights(df).collect())
    assert w == [(0, 0.5), (1, 0.5), (2, 1.0)]
    h = {r["class"]: r.n for r in class_histogram(df).collect()}
    assert h == {5: 2, 6: 1}


def test_explode_event_groups_aligns_and_null_fills(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0, 3.0], [10, 20])], "id long, pga array<double>, p_pick array<int>")
    out = [(r.trace_idx, r.pga, r.p_pick) for r in explode_event_groups(df, "id", ["pga", "p_pick"]).orderBy("trace_idx").collect()]
    assert out == [(0, 1.0, 10), (1, 2.0, 20), (2, 3.0, None)]

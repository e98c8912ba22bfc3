"""Property tests: chunks partition an event, masks are idempotent and monotone,
class counts add up, weights sum to the number of classes, mixtures are normalised."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quakeframe.functions.mixture import mixture_from_logits
from quakeframe.functions.waveform import fit_waveform
from quakeframe.operators.balance import class_histogram, label_weights
from quakeframe.operators.samples import build_samples, rank_traces

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

events = st.lists(st.tuples(st.integers(1, 60), st.integers(0, 30)), min_size=1, max_size=6)


@SETTINGS
@given(events, st.integers(2, 6))
def test_chunks_partition_each_event(spark, ev, m):
    rows = [(e, i, (i * 7 + e) % (p + 1), -1.0) for e, (n, p) in enumerate(ev) for i in range(n)]
    df = spark.createDataFrame(rows, "eq_id long, trace_idx int, p_pick int, pga double")
    s = build_samples(rank_traces(df, m))
    tg = s.filter(F.col("side") == "target")
    # every trace is a target exactly once; chunks hold at most m traces; inputs = chunk 0
    assert tg.count() == len(rows)
    assert tg.groupBy("eq_id", "trace_idx").count().filter("count != 1").count() == 0
    assert tg.groupBy("sample_id").count().filter(f"count > {m}").count() == 0
    bad_inputs = s.filter((F.col("side") == "input") & (F.col("pos") >= m)).count()
    assert bad_inputs == 0


@SETTINGS
@given(st.lists(st.floats(-3.5, 1.5, allow_nan=False), min_size=1, max_size=40))
def test_class_counts_and_weights(spark, labels):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "eq_id long, trace_idx int, pga double")
    h = class_histogram(df).collect()
    assert sum(r.n for r in h) == len(labels)
    w = label_weights(df).agg(F.sum("weight")).first()[0]
    assert math.isclose(w, len(h), rel_tol=1e-9)


@SETTINGS
@given(st.integers(0, 12), st.integers(0, 12), st.integers(1, 10))
def test_time_mask_idempotent_and_monotone(spark, c1, c2, n):
    w = [[float(i + 1), -float(i), 0.5] for i in range(n)]
    df = spark.createDataFrame([(w,)], "w array<array<float>>")
    lo, hi = sorted((c1, c2))
    once = fit_waveform("w", 10, F.lit(hi))
    r = df.select(once.alias("a"), fit_waveform(fit_waveform("w", 10, F.lit(hi)), 10, F.lit(hi)).alias("b"),
                  fit_waveform("w", 10, F.lit(lo)).alias("c")).first()
    assert r.a == r.b
    kept = lambda x: sum(1 for s in x if any(v != 0 for v in s))
    assert kept(r.c) <= kept(r.a)


@SETTINGS
@given(st.lists(st.floats(-20, 20, allow_nan=False), min_size=5, max_size=5))
def test_mixture_weights_sum_to_one(spark, logits):
    df = spark.createDataFrame([(logits, [0.0] * 5, [0.0] * 5)], "l array<double>, s array<double>, m array<double>")
    mix = df.select(mixture_from_logits("l", "s", "m").alias("x")).first().x
    assert math.isclose(sum(c.weight for c in mix), 1.0, rel_tol=1e-12)


@SETTINGS
@given(st.lists(st.floats(-1.24, 1.3, allow_nan=False), min_size=1, max_size=20))
def test_trace_copies_round_half_even(spark, labels):
    from quakeframe.operators.traces import trace_copy_count

    df = spark.createDataFrame([(x,) for x in labels], "l double")
    got = [r.n for r in df.select(trace_copy_count(F.col("l")).alias("n")).collect()]
    assert got == [round(4.5 ** (1.5 ** x) + 1) for x in labels]

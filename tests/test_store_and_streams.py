"""The bucketed waveform store, the stream's one writer, rule tables and supervision."""

import os

import pytest
from pyspark.sql import functions as F

from quakeframe.operators.evaluate import evaluation_points
from quakeframe.operators.samples import hydrate_inputs
from quakeframe.operators.scoring import AttenuationScorer
from quakeframe.operators.traces import explode_event_groups
from quakeframe.session import shared_dir
from quakeframe.sources import tables
from quakeframe.sources.snapshots_io import write_snapshots
from quakeframe.streaming.stream import Sinks, archive_consumed, read_sinks, route_by_table, route_targets, rule_segments, run_stream, supervise


def _waves(spark, events, per):
    return spark.range(events * per).select(
        (F.col("id") / per).cast("long").alias("eq_id"), (F.col("id") % per).cast("int").alias("trace_idx"),
        F.array_repeat(F.array(F.col("id").cast("float"), F.lit(1.0).cast("float"), F.lit(0.0).cast("float")), 4).alias("samples"))


def test_store_join_never_shuffles_waveforms(spark):
    w = _waves(spark, 50, 8)
    assert tables.write_waveform_store(w.filter("eq_id < 40"), "store_a", shared_dir(spark, "store"), buckets=6) == 6
    tables.append_waveforms(w.filter("eq_id >= 40 and trace_idx < 5"), "store_a")
    inputs = w.select("eq_id", "trace_idx", (F.col("trace_idx") * 10).alias("p_pick")).filter("trace_idx < 7").repartition(3)
    out = tables.hydrate_from_store(inputs, "store_a")
    stored = w.filter("eq_id < 40 or trace_idx < 5")
    want = sorted(map(str, hydrate_inputs(inputs, stored).collect()))
    assert sorted(map(str, out.select("eq_id", "trace_idx", "p_pick", "waveform").collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.rindex("FileScan"):]
    assert "Bucketed: true" in right and "SelectedBucketsCount: 6 out of 6" in right
    # Between the join and the scan of the waveforms lie a sort and a projection, no exchange.
    above = plan[:plan.rindex("FileScan")].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    chain, at = [], depth(plan[:plan.rindex("FileScan")].splitlines()[-1] + "X")
    for line in reversed(above[:-1]):
        if depth(line) < at:
            at = depth(line)
            chain.append(line)
    assert any("SortMergeJoin" in x for x in chain)
    assert not any("Exchange" in x for x in chain[:next(i for i, x in enumerate(chain) if "SortMergeJoin" in x)])


def test_store_spreads_a_hot_event(spark):
    w = _waves(spark, 1, 4000)  # every trace is of one event
    path = shared_dir(spark, "store")
    tables.write_waveform_store(w, "store_b", path, buckets=8)
    sizes = [r.n for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_store_buckets_follow_the_samples(spark):
    w = _waves(spark, 50, 8)  # 400 traces of 4 samples of 12 bytes
    assert tables.store_buckets(w, bucket_bytes=400 * 48 // 5) == 5
    assert tables.store_buckets(w.limit(0)) == 1
    spark.range(3).write.mode("overwrite").option("path", shared_dir(spark, "plain")).saveAsTable("no_store")
    with pytest.raises(ValueError):
        tables.append_waveforms(w, "no_store")


def _snaps(spark, n):
    wave = [[[float(i), 0.5, -0.5] for i in range(4)], [[0.1, 0.2, 0.3]] * 4]
    rows = [(i, 3, wave, [[21.0 + i, 121.0, 0.1], [0.0, 0.0, 0.0]]) for i in range(n)]
    return spark.createDataFrame(rows, "eq_id long, mask_sec int, waveform array<array<array<float>>>, station array<array<float>>").withColumn(
        "event_time", F.timestamp_seconds(F.lit(1_700_000_000)))


MODELS = [AttenuationScorer(0.5, 0.3, "a")]


@pytest.mark.parametrize("rules", [None, [("low", 0.0, 23.0)], "table"])
def test_sinks_have_one_schema(spark, rules):
    src, sink, ckpt = (shared_dir(spark, n) for n in ("o-src", "o-sink", "o-ckpt"))
    write_snapshots(_snaps(spark, 6), src, partition_by=None, files_per_partition=3)
    with open(os.path.join(src.replace("file:", ""), "bad.json"), "w") as f:
        f.write('{"event_time": "2024-01-01 00:00:00", "waveform": [[[0.1, 0.2\n')
        # A number that JSON does not have: lower-case nan.
        f.write('{"event_time": "2024-01-01 00:00:00", "waveform": [[[nan, 0.2, 0.1]]], "station": [[21.0, 121.0, 0.1]], "eq_id": 7, "mask_sec": 3}\n')
    if rules == "table":
        rules = shared_dir(spark, "o-rules")
        spark.createDataFrame([(0, "low", 0.0, 23.0)], "priority int, name string, lat_min double, lat_max double").write.parquet(rules)
    run_stream(spark, src, sink, ckpt, MODELS, rules=rules, max_files=2).awaitTermination()
    got = read_sinks(spark, Sinks.at(sink))
    kinds = {k: dict(spark.read.parquet(getattr(Sinks.at(sink), k)).dtypes) for k in got}
    same = lambda d: {c: "bigint" if c == "batch_id" else t for c, t in d.items()}  # noqa: E731  (a partition reads as int)
    assert {k: same(v) for k, v in kinds.items()} == {k: dict(v.dtypes) for k, v in got.items()}
    assert got["predictions"].count() == 6 and got["quarantine"].count() == 2
    assert {r.reason for r in got["quarantine"].collect()} == {"corrupt"}
    low = got["predictions"].filter("route = 'low'").count()
    assert low == (2 if rules else 0) and got["predictions"].filter("route not in ('low', 'other')").count() == 0
    r = got["report"].agg(*[F.sum(c).alias(c) for c in ("n_snapshots", "n_rejected", "n_predictions")]).first()
    assert tuple(r) == (6, 2, 6)


@pytest.mark.parametrize("where", ["predictions", "quarantine", "report"])
def test_restart_after_a_batch_died_between_sinks(spark, where):
    src, sink, ckpt = (shared_dir(spark, n) for n in ("d-src", "d-sink", "d-ckpt"))
    write_snapshots(_snaps(spark, 9), src, partition_by=None, files_per_partition=3)
    told = []

    def die(kind, batch_id):
        told.append((kind, batch_id))
        if (kind, batch_id) == (where, 1):
            raise RuntimeError("gone")

    status = supervise(spark, {"s": run_stream(spark, src, sink, ckpt, MODELS, on_written=die)}, 120).first()
    assert status.state == "failed" and "gone" in status.error and told[-1] == (where, 1)
    run_stream(spark, src, sink, ckpt, MODELS).awaitTermination()
    got = read_sinks(spark, Sinks.at(sink))
    assert sorted(r.eq_id for r in got["predictions"].collect()) == list(range(9))
    assert got["report"].agg(F.sum("n_predictions")).first()[0] == 9 and got["report"].count() == 3


def test_rules_are_read_again_for_each_batch(spark):
    src, sink, ckpt, rules = (shared_dir(spark, n) for n in ("l-src", "l-sink", "l-ckpt", "l-rules"))
    kind = "priority int, name string, lat_min double, lat_max double"
    spark.createDataFrame([(0, "first", None, None)], kind).write.parquet(rules)
    for k in range(2):
        write_snapshots(_snaps(spark, 2).withColumn("eq_id", F.col("eq_id") + 10 * k), f"{src}/{k}", partition_by=None, files_per_partition=1)

    def change(kind_, batch_id):
        if (kind_, batch_id) == ("report", 0):
            spark.createDataFrame([(0, "second", None, None)], kind).write.mode("overwrite").parquet(rules)

    run_stream(spark, f"{src}/*", sink, ckpt, MODELS, rules=rules, on_written=change).awaitTermination()
    got = read_sinks(spark, Sinks.at(sink))["predictions"]
    assert {(r.batch_id == 0, r.route) for r in got.collect()} == {(True, "first"), (False, "second")}


def test_supervise_tells_of_the_dead_and_stops_the_living(spark):
    src = shared_dir(spark, "v-src")
    write_snapshots(_snaps(spark, 6), src, partition_by=None, files_per_partition=3)

    def die(kind, batch_id):
        raise RuntimeError("no sink")

    sinks = [shared_dir(spark, "v-sink") for _ in range(2)]
    live = {n: run_stream(spark, src, s, shared_dir(spark, "v-ckpt"), MODELS, trigger={"processingTime": "200 milliseconds"}, on_written=f)
            for n, s, f in (("sound", sinks[0], None), ("broken", sinks[1], die))}
    got = {r.name: r for r in supervise(spark, live, 120).collect()}
    assert (got["sound"].state, got["sound"].error) == ("idle", None) and got["broken"].state == "failed" and "no sink" in got["broken"].error
    assert not any(q.isActive for q in live.values()) and read_sinks(spark, Sinks.at(sinks[0]))["predictions"].count() == 6


RULES = [(2, "wide", 20.0, 30.0), (1, "a", 22.0, 23.5), (1, "b", 23.0, 24.0), (0, "top", 29.5, None), (5, "south", None, -5.0), (3, "none", 9.0, 9.0),
         (0, "far", 200.0, 300.0)]


def test_route_by_table_is_first_match(spark):
    lats = [None, float("nan"), -1e9, -5.0, -5.0001, 0.0, 19.999, 20.0, 22.0, 23.0, 23.499, 23.5, 24.0, 29.5, 30.0, 90.0, 91.5, 250.0, 1e9, float("inf"), float("-inf")]
    preds = spark.createDataFrame([(i, x) for i, x in enumerate(lats)], "slot int, latitude double")
    rules = spark.createDataFrame(RULES, "priority int, name string, lat_min double, lat_max double")
    got = {r.slot: r.route for r in route_by_table(preds, rules).collect()}

    def want(x):
        if x is None or x != x:
            return "other"
        hits = [(p, n) for p, n, a, b in RULES if (a is None or x >= a) and (b is None or x < b) and (a is None or b is None or a < b)]
        return min(hits)[1] if hits else "other"

    assert got == {i: want(x) for i, x in enumerate(lats)}
    seg = sorted((r.lo, r.hi) for r in rule_segments(rules).collect())
    assert all(a[1] <= b[0] for a, b in zip(seg, seg[1:]))
    assert {r.route for r in route_by_table(preds, rules.limit(0)).collect()} == {"other"}
    static = [(n, a, b) for p, n, a, b in sorted(RULES[:3], key=lambda r: (r[0], r[1]))]
    table = route_by_table(preds.filter("latitude > 0"), rules.filter("name in ('wide', 'a', 'b')"))
    assert sorted(map(str, table.collect())) == sorted(map(str, route_targets(preds.filter("latitude > 0"), static).collect()))


def test_parallel_groups(spark):
    rows = [(1, [1.0, 2.0, 3.0], [5, 6], [0.1, 0.2, 0.3, 0.4], [7, 8, 9]), (2, None, [5], [0.1], [7]), (3, [1.0], None, None, [7]), (4, [], [1], [0.5], [2])]
    g = spark.createDataFrame(rows, "id long, traces array<double>, p_picks array<int>, pgv array<double>, pgv_time array<int>")
    out = explode_event_groups(g, "id", ["p_picks"], traces_col="traces", label_key="pgv")
    assert sorted(map(tuple, out.collect())) == sorted([(1, 0, 5, 0.1, 7), (1, 1, 6, 0.2, 8), (1, 2, None, 0.3, 9), (3, 0, None, None, 7)], key=str)
    longest = explode_event_groups(g, "id", ["traces", "p_picks"])  # no leading array: the longest counts
    assert longest.groupBy("eq_id").count().collect() and longest.count() == 3 + 1 + 1 + 1


def test_evaluation_points(spark):
    rows = [("m", 0, -5.5, -5.0), ("m", 1, 0.0, 0.2), ("m", 2, 3.0, float("nan")), ("m", 3, None, 0.2), ("k", 4, -0.6, -0.6)]
    p = spark.createDataFrame(rows, "model string, slot int, answer double, predict double")
    got = {r.slot: r for r in evaluation_points(p, "pga", ["model"]).collect()}
    assert len(got) == 5
    assert (got[0].answer_class, got[0].predict_class, got[0].same_class) == (0, 0, True)  # below the scale
    assert got[1].answer_label == "5-" and got[1].predict_label == "5+" and got[1].same_class is False
    assert got[2].answer_class == 9 and got[2].predict_class is None and got[2].n == 2
    assert got[3].answer_class is None and got[4].n == 1 and got[4].r2 is None and got[4].answer_threshold < -0.6 < got[4].answer_tick + 0.3
    assert evaluation_points(p, "pga").first().n == 3


def test_archive_holds_what_was_reported_only(spark):
    src, sink, ckpt, archive = (shared_dir(spark, n) for n in ("s-src", "s-sink", "s-ckpt", "s-arch"))
    write_snapshots(_snaps(spark, 9), src, partition_by=None, files_per_partition=3)

    def die(kind, batch_id):
        if (kind, batch_id) == ("quarantine", 1):
            raise RuntimeError("gone")

    lines = lambda d: spark.read.option("recursiveFileLookup", True).text(d).count()
    supervise(spark, {"s": run_stream(spark, src, sink, ckpt, MODELS, on_written=die)}, 120)
    assert archive_consumed(spark, Sinks.at(sink), archive) == 1
    left = lines(src)
    assert 0 < left < 9 and left + lines(archive) == 9
    run_stream(spark, src, sink, ckpt, MODELS).awaitTermination()
    assert archive_consumed(spark, Sinks.at(sink), archive) == 2 and archive_consumed(spark, Sinks.at(sink), archive) == 0
    assert lines(archive) == 9 and read_sinks(spark, Sinks.at(sink))["predictions"].count() == 9

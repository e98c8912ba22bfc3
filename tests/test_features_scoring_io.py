"""Waveform features, embedding, mixtures, evaluation, scoring, snapshot IO and streaming."""

import json
import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.functions.embedding import position_embedding
from quakeframe.functions.mixture import exceedance, mixture_from_logits, mixture_mean
from quakeframe.functions.waveform import log_peak_scale, normalise, peak_abs
from quakeframe.operators.evaluate import ensemble, evaluate
from quakeframe.operators.scoring import AttenuationScorer, make_runner, score
from quakeframe.schema import MIXTURE_TYPE
from quakeframe.session import shared_dir
from quakeframe.sources.snapshots_io import read_snapshots, validate_snapshots, write_snapshots
from quakeframe.streaming.stream import local_time, run_stream, score_snapshots


@pytest.mark.parametrize("peak, top, scale", [(1.0, 1.00019999, 0.0002), (0.5, None, -0.006731472),
                                              (0.0, 0.0002, -0.184006807)])
def test_normalise_and_scale(spark, peak, top, scale):
    w = [[peak, -peak / 2, 0.0]] * 4
    df = spark.createDataFrame([(w,)], "w array<array<float>>").withColumn("p", peak_abs("w"))
    r = df.select(log_peak_scale(F.col("p")).alias("s"),
                  F.array_max(F.flatten(normalise("w", F.col("p")))).alias("m")).first()
    assert r.s == pytest.approx(scale, abs=1e-9)
    if top is not None:
        assert r.m == pytest.approx(top, abs=1e-8)


def test_peak_abs_negative_and_empty(spark):
    df = spark.createDataFrame([([[-3.0, 1.0, 2.0]],), ([],)], "w array<array<float>>")
    assert [r.p for r in df.select(peak_abs("w").alias("p")).collect()] == [3.0, None]


def test_position_embedding_values(spark):
    df = spark.createDataFrame([(24.0, 121.0, 0.0)], "lat double, lon double, elev double")
    e = df.select(position_embedding().alias("e")).first().e
    assert len(e) == 150
    want = {0: -0.951057, 1: 0.309017, 2: 0.587785, 3: 0.809017, 4: 0.0, 5: -0.135995, 9: 1.0, 145: -0.811829,
            149: 1.0}
    for j, v in want.items():
        assert e[j] == pytest.approx(v, abs=1e-6)


def test_mixture_functions(spark):
    mix = [(0.5, 0.0, 1.0), (0.5, 1.0, 0.5)]
    df = spark.createDataFrame([(mix, 0.0)], f"m {MIXTURE_TYPE.simpleString()}, y double")
    r = df.select(exceedance("m", "y").alias("e"), mixture_mean("m").alias("mm")).first()
    assert r.e == pytest.approx(0.738625, abs=2e-6)
    assert r.mm == pytest.approx(0.5)
    lg = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0], [0.0] * 5, [1.0] * 5)], "l array<double>, s array<double>, m array<double>")
    m = lg.select(mixture_from_logits("l", "s", "m").alias("x")).first().x
    assert sum(c.weight for c in m) == pytest.approx(1.0)
    assert all(c.sigma == 1.0 for c in m)


def test_r2_matches_definition(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "answer double, predict double")
    r = evaluate(df).first()
    assert r.r2 == pytest.approx(-6.0) and r.n == 3
    assert (r.lim_lo, r.lim_hi) == (0.5, 3.5)
    const = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "answer double, predict double")
    assert evaluate(const).first().r2 == 1.0
    one = spark.createDataFrame([(1.0, 2.0)], "answer double, predict double")
    assert evaluate(one).first().r2 is None


def test_ensemble_of_equal_models_is_identity(spark):
    rows = [(m, "s", i, 1, 0.1 * i, 0.2) for m in ("a", "b") for i in range(4)]
    df = spark.createDataFrame(rows, "model string, sample_id string, slot int, eq_id long, predict double, answer double")
    e = ensemble(df, ["sample_id", "slot"], n_models=2).orderBy("slot").collect()
    assert [r.predict for r in e] == pytest.approx([0.0, 0.1, 0.2, 0.3])
    assert all(r.n_models == 2 and not r.answer_mismatch for r in e)


def test_scorer_contract_targets_independent(spark):
    sc = AttenuationScorer(0.5, 0.3, "a")
    sc.load()
    wave = np.zeros((2, 3, 10, 3))
    wave[:, 0, 2, 1] = -2.0, -7.0
    wave[:, 2] = 99.0  # no real station
    sta = np.array([[[24.0, 121.0, 0.1, 300.0], [24.1, 121.1, 0.0, 300.0], [0, 0, 0, 0]]] * 2)
    t_all = np.array([[24.0, 121.0, 0, 0], [25.0, 120.0, 0, 0], [25.0, 120.0, 0, 0]])
    w1, mu1, _ = sc.predict(wave, sta, t_all, np.array([0, 0, 1]))
    w2, mu2, _ = sc.predict(wave[:1], sta[:1], t_all[1:2], np.array([0]))
    assert np.allclose(mu1[1], mu2[0]) and np.isclose(w1.sum(axis=1), 1).all()
    assert np.allclose(mu1[2] - mu1[1], math.log10(7) - math.log10(2))  # another set, the same target


class Counted(AttenuationScorer):
    calls: list = []

    def predict(self, waveform, station, targets, owner):
        self.calls.append(len(waveform))
        return super().predict(waveform, station, targets, owner)


def test_one_call_per_shape(spark, monkeypatch):
    """A batch of several shapes, broken sets and empty target lists: each set as if alone."""
    from quakeframe.operators import scoring

    rng = np.random.default_rng(3)

    def row(k, s, t, n, zero=False):
        st = np.zeros((s, 4)) if zero else rng.normal(size=(s, 4))
        return (k, rng.normal(size=(s, t, 3)).astype(np.float32).tolist(), st.tolist(),
                [(i, *rng.normal(size=4).tolist()) for i in range(n)])

    rows = [row(i, 2 + i % 2, 4 + 3 * (i % 3), i % 4, zero=i % 7 == 3) for i in range(40)]
    rows += [(100, None, rows[0][2], rows[1][3]), (101, [], [], rows[1][3]), (102, rows[0][1], rows[1][2], rows[1][3]),
             (103, [[[1.0, 2.0, 3.0]], [[1.0, 2.0, 3.0]] * 2], rows[0][2], rows[1][3]), (104, rows[0][1], rows[0][2], None)]
    kind = "k long, waveform array<array<array<float>>>, station array<array<double>>, targets array<struct<slot:int, lat:double, lon:double, elev:double, vs30:double>>"
    df = spark.createDataFrame(rows, kind).coalesce(1)
    calls = Counted.calls
    calls.clear()
    schema = score(df, [AttenuationScorer(0.5, 0.3, "a")], ["k"]).schema
    run = make_runner([Counted(0.5, 0.3, "a")], ["k"], ["lat", "lon", "elev", "vs30"], schema)
    batches = df.toArrow().combine_chunks().to_batches()

    def got(some):
        return sorted(((r["k"], r["target"]["slot"], r["predict"], r["reason"]) for b in run(iter(some)) for r in b.to_pylist()), key=str)

    whole = got(batches)
    assert sum(calls) == sum(1 for r in rows[:40] if r[3] and r[0] % 7 != 3) and len(calls) == 6  # six shapes
    assert whole == got([b.slice(i, 1) for b in batches for i in range(b.num_rows)])
    reasons = {r[0]: r[3] for r in whole}
    assert all(reasons[k] == "ragged" for k in (100, 101, 102, 103)) and 104 not in reasons and reasons[3] == "no_station"
    monkeypatch.setattr(scoring, "CALL_BYTES", 200)
    assert whole == got(batches)


def test_score_mapinarrow(spark):
    w = [[[0.0, 1.5, 0.0]] * 4, [[0.0, 0.0, 0.0]] * 4]
    rows = [(1, w, [[24.0, 121.0, 0.1, 300.0], [0.0, 0.0, 0.0, 0.0]],
             [(0, 24.0, 121.0, 0.1, 300.0), (1, 25.0, 121.0, 0.1, 300.0)]),
            (2, w, [[0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0]], [(0, 24.0, 121.0, 0.1, 300.0)])]
    df = spark.createDataFrame(rows, "k long, waveform array<array<array<float>>>, station array<array<double>>, "
                                     "targets array<struct<slot:int, lat:double, lon:double, elev:double, vs30:double>>")
    out = score(df, [AttenuationScorer(0.5, 0.3, "a"), AttenuationScorer(1.0, 0.5, "b")], ["k"]).collect()
    # no real station: the rows stay, without a prediction and with the reason
    assert sorted((r.k, r.model, r.predict is None, r.reason) for r in out if r.k == 2) == [
        (2, "a", True, "no_station"), (2, "b", True, "no_station")]
    out = [r for r in out if r.k == 1]
    assert len(out) == 4 and all(r.reason is None for r in out)
    r = [x for x in out if x.model == "a" and x.target.slot == 1][0]
    mu0 = math.log10(1.5 + 1e-8) - 0.3 * 1.0
    assert r.predict == pytest.approx(mu0 + sum(c.weight * (c.mu - mu0) for c in r.mixture))


def _write_lines(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.json"), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_snapshot_quarantine(spark):
    good_w = [[[0.1, 0.2, 0.3]] * 3] * 2
    good = {"event_time": "2024-01-01 00:00:00", "waveform": good_w, "station": [[24.0, 121.0, 0.0]] * 2}
    lines = [
        json.dumps(good),
        json.dumps(good)[:40],                                                  # truncated
        json.dumps({**good, "waveform": [[0.1, 0.2, 0.3]]}),                    # wrong nesting
        json.dumps(good).replace("0.2", "NaN"),                                 # NaN is a number
        json.dumps(good).replace("0.2", "nan"),                                 # lower-case nan
        json.dumps({**good, "station": [[24.0, 121.0, 0.0, 300.0]] * 2}),     # 4-wide station
        json.dumps({**good, "station": [[24.0, 121.0]] * 2}),                   # 2-wide station
        json.dumps({**good, "waveform": good_w + good_w[:1], "station": [[24.0, 121.0, 0.0]] * 3}),
    ]
    path = tempfile.mkdtemp(prefix="qf-json-")
    _write_lines(path, lines)
    v = validate_snapshots(read_snapshots(spark, path).cache(), n_stations=2, length=3).collect()
    reasons = [r.reason for r in v]
    assert reasons[0] is None and reasons[3] is None and reasons[5] is None
    assert reasons[1] == "corrupt" and reasons[2] is not None and reasons[4] is not None
    assert reasons[6] == "bad_position" and reasons[7] == "station_count"


def _snapshots(spark, n):
    rows = []
    for i in range(n):
        w = [[[0.0, float(i + 1), 0.0]] * 5] * 3
        st = [[21.5 + i, 120.0, 0.0], [22.0, 121.0, 0.5], [0.0, 0.0, 0.0]]
        rows.append((i, 3, "2024-01-01 00:00:0%d" % (i % 10), w, st))
    return spark.createDataFrame(rows, "eq_id long, mask_sec int, t string, waveform array<array<array<float>>>, "
                                       "station array<array<float>>").withColumn("event_time", F.to_timestamp("t"))


def test_stream_equals_batch_and_restart_adds_nothing(spark):
    src, sink, ckpt = (shared_dir(spark, n) for n in ("t-src", "t-sink", "t-ckpt"))
    write_snapshots(_snapshots(spark, 6), src, partition_by=None, files_per_partition=3)
    models = [AttenuationScorer(0.5, 0.3, "a")]
    q = run_stream(spark, src, sink, ckpt, models, max_files=1)
    q.awaitTermination()
    streamed = spark.read.parquet(sink)
    batch = score_snapshots(read_snapshots(spark, src), models)
    key = ["eq_id", "mask_sec", "model", "slot", "predict"]
    assert sorted(map(tuple, streamed.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))
    assert streamed.count() == 12                     # 2 real stations per snapshot (one at sea level)
    q2 = run_stream(spark, src, sink, ckpt, models, max_files=1)
    q2.awaitTermination()
    assert spark.read.parquet(sink).count() == 12


def test_local_time(spark):
    df = spark.createDataFrame([("2024-01-01 20:00:01",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert df.select(local_time("t").alias("x")).first().x == "2024-01-02 04:00:01"


def test_runner_handles_sliced_batches():
    import pyarrow as pa

    from pyspark.sql import types as T
    t = pa.table({"k": pa.array([1, 2, 3], pa.int64()),
                  "waveform": pa.array([[[[1.0, 0.0, 0.0]]]] * 3, pa.list_(pa.list_(pa.list_(pa.float32())))),
                  "station": pa.array([[[24.0, 121.0, 0.0, 1.0]]] * 3, pa.list_(pa.list_(pa.float64()))),
                  "targets": pa.array([[{"lat": 24.0, "lon": 121.0, "elev": 0.0, "vs30": 1.0}]] * 3,
                                      pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64()),
                                                          ("elev", pa.float64()), ("vs30", pa.float64())])))})
    tt = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
                       T.StructField("elev", T.DoubleType()), T.StructField("vs30", T.DoubleType())])
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("target", tt),
                           T.StructField("model", T.StringType(), False), T.StructField("mixture", MIXTURE_TYPE),
                           T.StructField("predict", T.DoubleType()), T.StructField("reason", T.StringType())])
    run = make_runner([AttenuationScorer(0.5, 0.3, "a")], ["k"], ["lat", "lon", "elev", "vs30"], schema)
    out = list(run(iter(t.slice(1).to_batches())))
    assert out[0].num_rows == 2 and out[0].column("k").to_pylist() == [2, 3]


def test_point_prediction_choice(spark):
    from quakeframe.operators.evaluate import point_prediction

    df = spark.createDataFrame([([(0.25, 1.0, 1.0), (0.75, 2.0, 1.0)], 9.0)], f"mixture {MIXTURE_TYPE.simpleString()}, predict double")
    assert point_prediction(df, "mean").first().point == pytest.approx(1.75)
    assert point_prediction(df, "point").first().point == 9.0
    with pytest.raises(ValueError):
        point_prediction(df, "median")


def test_stream_archives_consumed_files(spark):
    from quakeframe.streaming.stream import await_all

    src, sink, ckpt, arch = (shared_dir(spark, n) for n in ("a-src", "a-sink", "a-ckpt", "a-arch"))
    write_snapshots(_snapshots(spark, 3), src, partition_by=None, files_per_partition=1)
    q = run_stream(spark, src, sink, ckpt, [AttenuationScorer(0.5, 0.3, "a")], max_files=1, archive_dir=arch)
    await_all(spark)
    assert spark.read.parquet(sink).count() == 6
    assert not q.isActive


def test_read_tables_conform(spark, tmp_path):
    from quakeframe.sources.tables import read_catalog, read_traces

    p = str(tmp_path / "cat.parquet")
    spark.createDataFrame([(5, 2016, 4.5, "x")], "EQ_ID int, year long, magnitude float, other string") \
        .write.parquet(p)
    c = read_catalog(spark, p, {"eq_id": "EQ_ID"})
    assert c.dtypes == [("eq_id", "bigint"), ("year", "int"), ("magnitude", "double")]
    t = str(tmp_path / "tr.parquet")
    spark.createDataFrame([(5, 0, 21.0, 120.0, 0.0, 100, -1.0, 300)],
                          "eq_id long, trace_idx int, lat double, lon double, elev double, p_pick int, "
                          "pga double, pga_time int").write.parquet(t)
    tr = read_traces(spark, t).first()
    assert tr.pgv is None and tr.pga == -1.0
    with pytest.raises(ValueError):
        read_catalog(spark, t)


def test_stream_batch_report(spark):
    from quakeframe.streaming.stream import run_stream_reported

    src, sink, rep, ckpt, qdir = (shared_dir(spark, n) for n in ("r-src", "r-sink", "r-rep", "r-ckpt", "r-q"))
    write_snapshots(_snapshots(spark, 5), src, partition_by=None, files_per_partition=2)
    _write_lines(src.replace("file:", ""), ['{"event_time": "2024-01-01 00:00:00", "waveform": [[[0.1, 0.2'])
    q = run_stream_reported(spark, src, sink, rep, ckpt, [AttenuationScorer(0.5, 0.3, "a")], max_files=1,
                            quarantine_dir=qdir)
    q.awaitTermination()
    report = spark.read.parquet(rep).collect()
    assert len(report) == 3 and sum(r.n_predictions for r in report) == 10
    assert sum(r.n_snapshots for r in report) == 5 and sum(r.n_rejected for r in report) == 1
    assert spark.read.parquet(sink).count() == 10
    bad = spark.read.parquet(qdir).collect()
    assert len(bad) == 1 and bad[0].reason == "corrupt"


def test_label_on_each_threshold(spark):
    from quakeframe.functions.intensity import LOG_PGA10, intensity10

    df = spark.createDataFrame([(float(b),) for b in LOG_PGA10], "pga double")
    got = [r.c for r in df.select(intensity10("pga").alias("c")).collect()]
    assert got == list(range(10))          # a label on a bound belongs to the upper class


def test_real_target_with_zero_answer_is_kept(spark):
    from quakeframe.operators.scoring import pad_predictions

    rows = [("a", "s1", 0, 1, 0.0, 0.3, 2), ("a", "s1", 1, 1, 0.5, 0.1, 2)]
    df = spark.createDataFrame(rows, "model string, sample_id string, slot int, eq_id long, answer double, "
                                     "predict double, chunk_size int")
    p = pad_predictions(df, ["model", "sample_id"], 4).collect()
    assert len(p) == 4 and sum(r.is_real for r in p) == 2
    zero = [r for r in p if r.slot == 0][0]
    assert zero.is_real and zero.answer == 0.0      # the reference's answer != 0 would drop it (D4)


def test_two_snapshots_in_one_batch_keep_their_own_targets(spark):
    from quakeframe.streaming.stream import score_snapshots

    w = [[[0.0, 1.0, 0.0]] * 4] * 4
    one = [[24.0, 121.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    three = [[24.0, 121.0, 0.0], [0.0, 0.0, 0.0], [24.5, 121.5, 0.0], [25.0, 120.0, 0.3]]
    df = spark.createDataFrame([(1, 3, w, one), (2, 3, w, three)],
                               "eq_id long, mask_sec int, waveform array<array<array<float>>>, "
                               "station array<array<float>>")
    out = score_snapshots(df, [AttenuationScorer(0.5, 0.3, "a")]).collect()
    per = sorted((r.eq_id, r.slot) for r in out)
    assert per == [(1, 0), (2, 0), (2, 2), (2, 3)]   # by row per snapshot, blanked slot skipped (D5)


def test_24_station_snapshot_is_quarantined(spark):
    good = {"event_time": "2024-01-01 00:00:00", "waveform": [[[0.1, 0.2, 0.3]] * 2] * 24,
            "station": [[24.0, 121.0, 0.0]] * 24}
    path = tempfile.mkdtemp(prefix="qf-json24-")
    _write_lines(path, [json.dumps(good)])
    v = validate_snapshots(read_snapshots(spark, path), n_stations=25).first()
    assert v.valid is False and v.reason == "station_count"


def test_partitioned_snapshot_roundtrip(spark):
    path = shared_dir(spark, "part-snaps")
    write_snapshots(_snapshots(spark, 4), path)               # default: one folder per mask_sec
    back = read_snapshots(spark, path)
    rows = back.select("eq_id", "mask_sec", F.size("waveform").alias("s")).collect()
    assert sorted((r.eq_id, r.mask_sec, r.s) for r in rows) == [(i, 3, 3) for i in range(4)]
    assert validate_snapshots(back, n_stations=3, length=5).filter("valid").count() == 4


def test_input_sets_flatten_and_ensemble_check(spark):
    from quakeframe.operators.evaluate import check_ensemble
    from quakeframe.operators.scoring import flatten_predictions, input_sets

    rows = [(1, 1, [[1.0, 2.0, 3.0]] * 2, 24.0, 121.0, 0.1, 300.0), (1, 0, [[4.0, 5.0, 6.0]] * 3, 23.0, 120.0, 0.0, 250.0)]
    df = spark.createDataFrame(rows, "eq_id long, slot int, waveform array<array<float>>, lat double, lon double, "
                                     "elev double, vs30 double")
    s = input_sets(df, ["eq_id"], 3, 4).first()
    assert [len(w) for w in s.waveform] == [4, 4, 4] and s.waveform[0][0] == [4.0, 5.0, 6.0]
    assert s.station[0] == [23.0, 120.0, 0.0, 250.0] and s.station[2] == [0.0] * 4

    w = [[[0.0, 1.5, 0.0]] * 4]
    sc = spark.createDataFrame([(1, w, [[24.0, 121.0, 0.1, 300.0]], [(7, 24.0, 121.0, 0.1, 300.0)])],
                               "k long, waveform array<array<array<float>>>, station array<array<double>>, "
                               "targets array<struct<slot:int, lat:double, lon:double, elev:double, vs30:double>>")
    flat = flatten_predictions(score(sc, [AttenuationScorer(0.5, 0.3, "a")], ["k"]), ["k"], ["slot", "lat"]).first()
    assert (flat.k, flat.slot, flat.lat, flat.model) == (1, 7, 24.0, "a")

    good = spark.createDataFrame([("a", "s", 0, 0.1, 1.0), ("b", "s", 0, 0.2, 1.0)],
                                 "model string, sample_id string, slot int, predict double, answer double")
    check_ensemble(ensemble(good, ["sample_id", "slot"], 2), 2)
    bad = good.union(spark.createDataFrame([("a", "t", 0, 0.1, 1.0)], good.schema))
    with pytest.raises(ValueError):
        check_ensemble(ensemble(bad, ["sample_id", "slot"], 2), 2)

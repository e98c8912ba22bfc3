"""Rows that cannot be served stay, marked, instead of vanishing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quakeframe.operators.balance import label_weights
from quakeframe.operators.evaluate import ensemble, split_ensemble
from quakeframe.operators.masking import apply_cutoff
from quakeframe.operators.samples import hydrate_inputs, input_traces, missing_waveforms, rank_traces
from quakeframe.operators.scoring import AttenuationScorer, score
from quakeframe.plans.dataset import DatasetOptions, build_dataset
from quakeframe.sources import fixtures as fx
from quakeframe.sources.snapshots_io import read_predictions, write_predictions
from quakeframe.streaming.stream import local_time
from tests.conftest import SF_SMALL

TRACE = ("eq_id long, trace_idx int, lat double, lon double, elev double, vs30 double, p_pick int, "
         "pga double, pga_time int, pgv double, pgv_time int")


def _traces(spark, n=3, eq=1):
    return spark.createDataFrame([(eq, i, 21.0 + i, 120.0, 0.1, 300.0, 100 + 10 * i, -1.0, 200, -2.0, 200) for i in range(n)], TRACE)


def _waves(spark, which, eq=1):
    w = [[1.0, 0.5, 0.0]] * 300
    return spark.createDataFrame([(eq, i, w) for i in which], "eq_id long, trace_idx int, samples array<array<float>>")


def test_missing_waveform_keeps_slot_and_reference_pick(spark):
    r = rank_traces(_traces(spark), 25)
    waves = _waves(spark, [1, 2])
    inputs = input_traces(r)
    out = apply_cutoff(hydrate_inputs(inputs, waves), 3, 10, 200).orderBy("slot").collect()
    assert [(x.slot, x.pick0, x.cutoff, x.blanked) for x in out] == [(0, 100, 130, True), (1, 100, 130, False), (2, 100, 130, False)]
    assert out[0].lat == 0.0 and not any(v for s in out[0].waveform for v in s)
    assert sum(any(s) for s in out[1].waveform) == 130
    assert [x.trace_idx for x in missing_waveforms(inputs, waves).collect()] == [0]


def test_builder_keeps_events_without_any_waveform(spark):
    catalog = spark.createDataFrame([(1, 2000, 5.0), (2, 2000, 5.0)], "eq_id long, year int, magnitude double")
    traces = _traces(spark).unionByName(_traces(spark, eq=2))
    o = DatasetOptions(sampling_rate=10, data_length_sec=20, mode="all", mask_waveform_sec=3, max_station_num=3, label_target=3)
    out = {r.eq_id if "eq_id" in r else r.sample_id: r for r in build_dataset(catalog, traces, _waves(spark, [1, 2]), o).collect()}
    assert len(out) == 2
    a, b = out[1], out[2]
    assert a.sta[0] == [0.0] * 4 and a.sta[1][0] == 22.0 and a.target[0][0] == 21.0
    assert sum(any(s) for s in a.waveform[1]) == 130
    assert b.sta == [[0.0] * 4] * 3 and b.target[0][0] == 21.0 and not any(v for w in b.waveform for s in w for v in s)


def test_ragged_input_set_is_reported(spark):
    ok = [[[1.0, 0.0, 0.0]] * 2, [[1.0, 0.0, 0.0]] * 2]
    st = [[24.0, 121.0, 0.0, 1.0]] * 2
    tg = [(24.0, 121.0, 0.0, 1.0)]
    rows = [(1, ok, st, tg), (2, [ok[0], ok[0][:1]], st, tg), (3, None, st, tg)]
    df = spark.createDataFrame(rows, "k long, waveform array<array<array<float>>>, station array<array<double>>, "
                                     "targets array<struct<lat:double, lon:double, elev:double, vs30:double>>")
    out = score(df, [AttenuationScorer(0.5, 0.3, "a")], ["k"]).collect()
    assert sorted((r.k, r.predict is None, r.reason) for r in out) == [(1, False, None), (2, True, "ragged"), (3, True, "ragged")]


def test_unlabelled_traces_keep_a_weight(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, float("nan")), (1, 2, 0.5)], "eq_id long, trace_idx int, pga double")
    assert sorted((r.trace_idx, r.weight) for r in label_weights(df).collect()) == [(0, 0.5), (1, 0.5), (2, 1.0)]


def test_ensemble_split(spark):
    rows = [("a", 1, 0, 1.0, 3.0), ("b", 1, 0, 3.0, 3.0), ("a", 2, 0, 1.0, 3.0), ("a", 3, 0, 1.0, 3.0), ("b", 3, 0, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "model string, sample_id int, slot int, predict double, answer double")
    good, bad = split_ensemble(ensemble(df, ["sample_id", "slot"]), 2)
    assert [(r.sample_id, r.predict) for r in good.collect()] == [(1, 2.0)]
    assert sorted(r.sample_id for r in bad.collect()) == [2, 3]


def test_predictions_keep_their_cutoff(spark, tmp_path):
    rows = [("a", s, "1/0/0/0", 0, float(s), 1.0) for s in (3, 5)]
    df = spark.createDataFrame(rows, "model string, mask_sec int, sample_id string, slot int, predict double, answer double")
    full = df.select("model", "sample_id", "slot", F.lit(1).cast("long").alias("eq_id"), F.lit(1).alias("p_pick"), F.lit(1).alias("label_time"),
                     "predict", "answer", F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.lit(0.0).alias("elevation"), "mask_sec")
    write_predictions(full, str(tmp_path / "p"))
    back = read_predictions(spark, str(tmp_path / "p"), with_cutoff=True)
    e = ensemble(back, ["mask_sec", "sample_id", "slot"]).collect()
    assert sorted((r.mask_sec, r.predict) for r in e) == [(3, 3.0), (5, 5.0)]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Taipei", "America/New_York"])
def test_local_time_in_any_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.sql("SELECT timestamp_seconds(0) AS t, TIMESTAMP_NTZ '1970-01-01 00:00:00' AS n")
        r = df.select(local_time("t").alias("t"), local_time("n", naive=True).alias("n")).first()
        assert (r.t, r.n) == ("1970-01-01 08:00:00", "1970-01-01 08:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_every_vector_is_used_and_some_traces_have_none(spark):
    n = fx.read_table(spark, SF_SMALL, "embeddings").count()
    links = fx.fx_trace_vectors(spark, SF_SMALL)
    assert links.filter(F.col("vec_id") < n).select("vec_id").distinct().count() == n
    assert 0 < links.filter(F.col("vec_id") >= n).count()


def test_checkpoint_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from quakeframe import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_plain_snapshot_lines_are_named_by_their_file(spark, tmp_path):
    import json

    from quakeframe.sources.snapshots_io import identify_snapshots, read_snapshots

    line = {"event_time": "2024-01-01 00:00:00", "waveform": [[[0.0, 1.0, 2.0]]], "station": [[24.0, 121.0, 0.0]]}
    (tmp_path / "77_5_sec.json").write_text(json.dumps(line) + "\n")
    (tmp_path / "other.json").write_text(json.dumps({**line, "eq_id": 9, "mask_sec": 3}) + "\n")
    out = identify_snapshots(read_snapshots(spark, str(tmp_path))).select("eq_id", "mask_sec").collect()
    assert sorted((r.eq_id, r.mask_sec) for r in out) == [(9, 3), (77, 5)]


@pytest.mark.parametrize("order", ["stored", "pick"])
def test_ladder_snapshots_equal_the_assembled_ladder(spark, order):
    from quakeframe.operators.snapshots import assemble_snapshots, ladder_snapshots, snapshot_ladder

    traces = _traces(spark, 4).unionByName(_traces(spark, 2, eq=2)).withColumn("p_pick", F.expr("CASE WHEN trace_idx = 0 THEN 125 ELSE p_pick END"))
    waves = _waves(spark, [0, 1, 3]).unionByName(_waves(spark, [1], eq=2))
    ids = spark.createDataFrame([(1,), (2,)], "eq_id long")
    kw = {"secs": [1, 3], "rate": 10, "length": 20, "max_station_num": 3, "order": order}
    a = assemble_snapshots(snapshot_ladder(traces, waves, ids, **kw), max_station_num=3, length=20)
    b = ladder_snapshots(traces, waves, ids, **kw)
    assert sorted(a.collect()) == sorted(b.collect()) and b.count() == 4


def test_every_snapshot_line_has_its_reason(spark):
    """The reason follows the line's own event: counts alone would not show swapped reasons."""
    from quakeframe.plans import queries as q

    from .conftest import SF_SMALL

    reasons = {0: None, 2: "ragged_time", 3: "station_count", 4: "station_count_mismatch", 5: "missing", 6: "bad_position", 7: None}
    rows = q.QUERIES["validate_snapshot_lines"](spark, SF_SMALL).collect()
    assert rows and all((r.eq_id is None) == (r.reason == "corrupt") for r in rows)
    assert all(r.reason == reasons[r.eq_id % q.BAD_KINDS] for r in rows if r.eq_id is not None)

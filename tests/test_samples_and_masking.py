"""Chunking, sample plan, skew-safe ranking and cut-off masking."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quakeframe.functions.waveform import fit_waveform
from quakeframe.operators.masking import apply_cutoff, blind_stations, pad_slots, with_pick0
from quakeframe.operators.ranking import group_positions
from quakeframe.operators.samples import build_samples, input_traces, rank_traces, sample_weights


def _traces(spark, n, eq_id=1):
    rows = [(eq_id, i, (i * 37) % 11, -1.0) for i in range(n)]
    return spark.createDataFrame(rows, "eq_id long, trace_idx int, p_pick int, pga double")


@pytest.mark.parametrize("n, samples, targets", [(25, 1, [25]), (26, 2, [25, 1]), (50, 2, [25, 25]),
                                                  (51, 3, [25, 25, 1])])
def test_chunks(spark, n, samples, targets):
    s = build_samples(rank_traces(_traces(spark, n), 25))
    per = s.groupBy("chunk_no", "side").count().collect()
    t = sorted((r.chunk_no, r["count"]) for r in per if r.side == "target")
    i = sorted((r.chunk_no, r["count"]) for r in per if r.side == "input")
    assert [c for _, c in t] == targets
    assert len(t) == samples
    assert all(c == min(n, 25) for _, c in i) and len(i) == samples


@pytest.mark.parametrize("n, samples", [(26, 4), (51, 6), (25, 1)])
def test_bias_samples(spark, n, samples):
    s = build_samples(rank_traces(_traces(spark, n), 25), bias_to_closer_station=True)
    assert s.select("sample_id").distinct().count() == samples
    bias_targets = s.filter(F.col("is_bias") & (F.col("side") == "target"))
    assert bias_targets.filter(F.col("pos") >= 25).count() == 0


def test_inputs_are_chunk_zero_sorted_by_pick(spark):
    r = rank_traces(_traces(spark, 30), 25)
    inp = input_traces(r).orderBy("slot").collect()
    picks = [x.p_pick for x in inp]
    assert picks == sorted(picks) and len(inp) == 25
    assert all(x.pick0 == picks[0] for x in inp)


def test_stored_order_puts_copies_last(spark):
    rows = [(1, 0, 5, 0), (1, 1, 1, 0), (1, 0, 5, 1), (1, 0, 5, 2)]
    df = spark.createDataFrame(rows, "eq_id long, trace_idx int, p_pick int, trace_copy int")
    r = rank_traces(df, 25, sort_by_picks=False).orderBy("pos").collect()
    assert [(x.trace_idx, x.trace_copy) for x in r] == [(0, 0), (1, 0), (0, 1), (0, 2)]


def test_sample_weight_bias_gets_chunk_zero_mean(spark):
    rows = [(1, i, i, 0.0, 1.0 if i < 2 else 3.0) for i in range(3)]
    df = spark.createDataFrame(rows, "eq_id long, trace_idx int, p_pick int, pga double, weight double")
    s = build_samples(rank_traces(df, 2), bias_to_closer_station=True)
    w = {(r.chunk_no, r.is_bias): r.weight for r in sample_weights(s).collect()}
    assert w == {(0, False): 1.0, (1, False): 3.0, (0, True): 1.0, (1, True): 1.0}


def test_group_positions_hot_key_matches_row_number(spark):
    # one event holds most rows, the rest are small; positions must equal row_number - 1
    rows = [(1, i, (i * 7919) % 1000) for i in range(20000)] + \
           [(k, i, (k * i) % 13) for k in range(2, 300) for i in range(k % 9 + 1)]
    df = spark.createDataFrame(rows, "eq_id long, trace_idx int, p_pick int").repartition(6)
    got = group_positions(df, ["eq_id"], ["p_pick", "trace_idx"], num_partitions=16)
    w = Window.partitionBy("eq_id").orderBy("p_pick", "trace_idx")
    want = df.withColumn("want", F.row_number().over(w) - 1).withColumn("want_n", F.count("*").over(Window.partitionBy("eq_id")))
    j = got.join(want, ["eq_id", "trace_idx"])
    assert j.count() == len(rows)
    assert j.filter((F.col("pos") != F.col("want")) | (F.col("group_size") != F.col("want_n"))).count() == 0
    # the hot event really was split over several range partitions
    parts = (df.repartitionByRange(16, "eq_id", "p_pick", "trace_idx")
             .filter(F.col("eq_id") == 1).select(F.spark_partition_id().alias("p")).distinct().count())
    assert parts > 1


def test_fit_waveform_edges(spark):
    w3 = [[1.0, 1.0, 1.0]]
    df = spark.createDataFrame([([],), (w3 * 2,), (w3 * 10,)], "w array<array<float>>")
    out = [len(r.x) for r in df.select(fit_waveform("w", 5).alias("x")).collect()]
    assert out == [5, 5, 5]
    masked = df.select(fit_waveform("w", 5, F.lit(3)).alias("x")).collect()[2].x
    assert [s[0] for s in masked] == [1.0, 1.0, 1.0, 0.0, 0.0]
    neg = df.select(fit_waveform("w", 5, F.lit(-2)).alias("x")).collect()[2].x
    assert all(s == [0.0, 0.0, 0.0] for s in neg)
    beyond = df.select(fit_waveform("w", 5, F.lit(99)).alias("x")).collect()[2].x
    assert all(s == [1.0, 1.0, 1.0] for s in beyond)


def test_cutoff_edge_kept_and_later_blanked(spark):
    # rate 200, 3 s, pick0 = 100 -> cutoff sample 700: a pick at 700 is kept, 701 blanked
    w = [[1.0, -2.0, 0.5]] * 1000
    rows = [(1, 0, 100, 21.0, 120.0, 0.1, 300.0, w), (1, 1, 700, 22.0, 121.0, 0.2, 300.0, w),
            (1, 2, 701, 23.0, 122.0, 0.3, 300.0, w)]
    df = spark.createDataFrame(rows, "eq_id long, slot int, p_pick int, lat double, lon double, elev double, "
                                     "vs30 double, waveform array<array<float>>")
    m = apply_cutoff(with_pick0(df, ["eq_id"]), 3, 200, 1000).orderBy("slot").collect()
    assert [r.blanked for r in m] == [False, False, True]
    assert m[0].cutoff == 700
    nz = [sum(1 for s in r.waveform if any(x != 0 for x in s)) for r in m]
    assert nz == [700, 700, 0]
    assert (m[2].lat, m[2].lon, m[2].elev, m[2].vs30) == (0.0, 0.0, 0.0, 0.0)


def test_masks_are_monotone_in_the_cutoff(spark):
    rows = [(1, i, 10 * i, 21.0 + i, 120.0, 0.0, 300.0) for i in range(8)]
    df = with_pick0(spark.createDataFrame(rows, "eq_id long, slot int, p_pick int, lat double, lon double, elev double, vs30 double"), ["eq_id"])
    blanked = [apply_cutoff(df, s, 10, 100).filter("blanked").count() for s in (1, 3, 5, 7)]
    assert blanked == sorted(blanked, reverse=True)


def test_blinding_bounds(spark):
    rows = [(s, i, 21.0 if i < 5 else 0.0) for s in range(200) for i in range(6)]
    df = spark.createDataFrame(rows, "sid long, slot int, lat double")
    b = blind_stations(df, ["sid"], position_cols=("lat",))
    per = b.groupBy("sid").agg(F.sum(F.col("blinded").cast("int")).alias("k")).collect()
    ks = [r.k for r in per]
    assert max(ks) <= 4 and min(ks) == 0 and len(set(ks)) > 2
    assert b.filter(F.col("blinded") & (F.col("slot") >= 5)).count() == 0


def test_blinding_more_stations_than_slots_is_an_error(spark):
    df = spark.createDataFrame([(1, i, 21.0) for i in range(6)], "sid long, slot int, lat double")
    assert blind_stations(df, ["sid"], position_cols=("lat",), n_slots=6).count() == 6
    with pytest.raises(Exception, match="more than 5 stations"):
        blind_stations(df, ["sid"], position_cols=("lat",), n_slots=5).collect()


def test_blinding_all_zero_gives_nothing(spark):
    df = spark.createDataFrame([(1, i, 0.0) for i in range(3)], "sid long, slot int, lat double")
    assert blind_stations(df, ["sid"], position_cols=("lat",)).filter("blinded").count() == 0


def test_pad_slots_no_truncation(spark):
    df = spark.createDataFrame([(1, i) for i in range(3)] + [(2, i) for i in range(6)], "g long, slot int")
    p = pad_slots(df, ["g"], 4)
    got = {r.g: r.n for r in p.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 4, 2: 6}
    assert p.filter("is_padding").select("slot").first().slot == 3


def _member_rows(spark, n=80):
    """Samples of 1 to 4 members; some late, some without position, some without a pick."""
    rows = []
    for s in range(n):
        for slot in range(1 + s % 4):
            w = [[float(slot + 1), -0.5, float(t)] for t in range(6)]
            pos = [21.0 + slot, 120.0, 0.0, 300.0] if (s + slot) % 7 else [0.0, 0.0, 0.0, 0.0]
            rows.append((f"s{s}", slot, None if slot and s % 9 == 0 else 10 + slot * (s % 5), pos, w))
    return spark.createDataFrame(rows, "sid string, slot int, p_pick int, pos array<double>, waveform array<array<float>>")


def test_late_members_equal_late_rows(spark):
    """mask_members on collected arrays == apply_cutoff on rows."""
    from quakeframe.operators.masking import mask_members

    df = _member_rows(spark)
    r = df.select("sid", "slot", "p_pick", "waveform", *[F.col("pos")[i].alias(c) for i, c in enumerate(["lat", "lon", "elev", "vs30"])])
    r = apply_cutoff(with_pick0(r, ["sid"]), 1, 3, 8)
    want = {(x.sid, x.slot): (x.blanked, [list(v) for v in x.waveform], x.lat) for x in r.collect()}
    g = df.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("slot", "p_pick", "pos", "waveform"))).alias("m"))
    g = g.withColumn("m", mask_members("m", (F.col("m")[0]["p_pick"] + 3).cast("int"), 8))
    got = {(x.sid, e.slot): (e.blanked, [list(v) for v in e.waveform], e.pos[0]) for x in g.collect() for e in x.m}
    assert got == want and any(v[0] for v in got.values())


@pytest.mark.parametrize("sec", [None, 1])
@pytest.mark.parametrize("blind", [False, True])
def test_slot_masks_equal_row_masks(spark, sec, blind):
    """The slot mask of a sample and its one pass over the waveforms == cut-off, blanking, blinding
    and padding on rows."""
    from quakeframe.functions.waveform import fit_waveform, zero_samples
    from quakeframe.operators.masking import hidden_positions, hidden_waveforms, with_slot_mask

    df = _member_rows(spark)
    r = df.select("sid", "slot", "p_pick", "waveform", *[F.col("pos")[i].alias(c) for i, c in enumerate(["lat", "lon", "elev", "vs30"])])
    r = apply_cutoff(with_pick0(r, ["sid"]), sec, 3, 8)
    if blind:
        r = blind_stations(r, ["sid"], length=8)
    want = {}
    for x in sorted(r.collect(), key=lambda x: (x.sid, x.slot)):
        waves, sta = want.setdefault(x.sid, ([], []))
        waves.append([list(v) for v in x.waveform])
        sta.append([x.lat, x.lon, x.elev, x.vs30])
    for waves, sta in want.values():
        waves += [[[0.0] * 3] * 8] * (4 - len(waves))
        sta += [[0.0] * 4] * (4 - len(sta))
    member = F.struct("slot", "p_pick", "pos", fit_waveform("waveform", 8).alias("w"))
    g = df.groupBy("sid").agg(F.sort_array(F.collect_list(member)).alias("m")).select(
        "sid", F.concat(F.col("m.w"), F.array(zero_samples(8))).alias("waves"), F.col("m.pos").alias("pos"),
        F.transform("m", lambda e: F.struct(e["slot"].alias("slot"), e["p_pick"].alias("p_pick"),
                                            F.exists(e["pos"], lambda x: x != 0).alias("real"))).alias("st"))
    cutoff = (F.col("st")[0]["p_pick"] + 3 * sec).cast("int") if sec else F.lit(None).cast("int")
    g = with_slot_mask(g, "st", cutoff, [F.col("sid")] if blind else None, 4)
    got = g.select("sid", hidden_waveforms("waves", "hidden", cutoff, 4).alias("w"), hidden_positions("pos", "hidden", 4).alias("p"))
    assert {x.sid: ([[list(t) for t in w] for w in x.w], [list(p) for p in x.p]) for x in got.collect()} == want


def test_scoring_rows_salt_hot_event(spark):
    from quakeframe.operators.scoring import scoring_rows, target_groups

    sets = spark.createDataFrame([(1, 5000, 1.0), (2, 3, 2.0)], "eq_id long, n_chunks int, x double")
    tg = spark.createDataFrame([(1, c, s) for c in range(5000) for s in range(2)] + [(2, c, 0) for c in range(3)],
                               "eq_id long, chunk_no int, slot int")
    groups = target_groups(tg, ["eq_id"], ["chunk_no", "slot"], per_row=1024)
    rows = scoring_rows(sets, groups, ["eq_id"], per_row=1024)
    per = {r.eq_id: r.n for r in rows.groupBy("eq_id").agg(F.count("*").alias("n")).collect()}
    assert per == {1: 5, 2: 1}
    total = rows.select(F.explode("targets")).count()
    assert total == 10003


def test_duplicate_catalogue_rejected(spark):
    from quakeframe.plans.dataset import DatasetOptions, sample_plan

    cat = spark.createDataFrame([(1, 2000, 5.0), (1, 2000, 5.0)], "eq_id long, year int, magnitude double")
    tr = _traces(spark, 3)
    with pytest.raises(ValueError):
        sample_plan(cat, tr, DatasetOptions(mode="all"))


def test_group_positions_null_key_and_empty(spark):
    rows = [(k, i, (i * 3) % 5) for k in (None, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "eq_id long, trace_idx int, p_pick int")
    got = group_positions(df, ["eq_id"], ["p_pick", "trace_idx"])
    assert sorted((r.eq_id is None, r.pos, r.group_size) for r in got.collect()) == [(n, p, 6) for n in (False, True) for p in range(6)]
    assert group_positions(df.limit(0), ["eq_id"], ["p_pick", "trace_idx"]).count() == 0


def test_null_pick_is_not_blanked(spark):
    rows = [(1, 0, 10, 21.0), (1, 1, None, 22.0)]
    df = with_pick0(spark.createDataFrame(rows, "eq_id long, slot int, p_pick int, lat double"), ["eq_id"])
    out = apply_cutoff(df, 1, 1, 5).orderBy("slot").collect()
    assert [r.blanked for r in out] == [False, False] and out[1].lat == 22.0


def test_sample_weight_worked_value(spark):
    import math

    from quakeframe.operators.balance import label_weights

    rows = [(1, 0, 1, math.log10(0.9)), (1, 1, 2, math.log10(0.9)), (1, 2, 3, math.log10(3.0))]
    df = spark.createDataFrame(rows, "eq_id long, trace_idx int, p_pick int, pga double")
    s = build_samples(rank_traces(label_weights(df, "pga"), 25))
    w = sample_weights(s).first()
    assert math.isclose(w.weight, 2 / 3) and w.n_targets == 3


def test_exact_small_sample(spark):
    from quakeframe.operators.catalog import select_events

    rows = [(i, 2001 if i % 3 else 2002, 1.0 + (i % 20) / 10) for i in range(400)]
    cat = spark.createDataFrame(rows, "eq_id long, year int, magnitude double")
    a = select_events(cat, 2.5, True, 2002, exact=True)
    b = select_events(cat.repartition(7), 2.5, True, 2002, exact=True)
    ka = sorted(r.eq_id for r in a.filter("is_small").collect())
    kb = sorted(r.eq_id for r in b.filter("is_small").collect())
    n_cand = sum(1 for i, y, m in rows if m < 2.5 and y != 2002)
    assert ka == kb and len(ka) == round(n_cand * 0.25)


def test_smallest_draws_take_exactly_the_smallest(spark, monkeypatch):
    """Few bins: many rows share the border bin; ties go to the smaller id."""
    from quakeframe.operators import catalog

    draws = {i: ((i * 37) % 64) / 64 for i in range(300)}
    df = spark.createDataFrame(list(draws.items()), "eq_id long, u double").repartition(5)
    for bins in (1, 8, 64, 1 << 16):
        monkeypatch.setattr(catalog, "DRAW_BINS", bins)
        for fraction in (0.0, 0.001, 0.25, 0.5, 0.999, 1.0):
            got = sorted(r.eq_id for r in catalog.smallest_draws(df, F.col("u"), fraction).collect())
            want = sorted(draws, key=lambda i: (draws[i], i))[:round(300 * fraction)]
            assert got == sorted(want), (bins, fraction)
    assert catalog.smallest_draws(df.limit(0), F.col("u"), 0.25).count() == 0


def test_first_events_have_no_single_task_merge(spark):
    from quakeframe.operators.catalog import first_events

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("eq_id"), F.lit(2000).alias("year"))
    out = first_events(df, 400)
    assert sorted(r.eq_id for r in out.collect()) == list(range(400)) and out.columns == ["eq_id", "year"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert first_events(df, None).count() == 1000 and first_events(df, 5000).count() == 1000
    assert first_events(df.limit(0), 3).count() == 0

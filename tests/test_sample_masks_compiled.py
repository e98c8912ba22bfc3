"""The per-sample steps are compiled apart from the rest of their stage (one method of it all runs slowly)."""

from pyspark.sql import functions as F

from quakeframe.operators.masking import blinded_slots, hidden_positions, hidden_waveforms, with_slot_mask


def _samples(spark):
    rows = [(1, [[[1.0], [2.0]], [[3.0], [4.0]], [[0.0], [0.0]]], [[1.0, 2.0], [3.0, 4.0]], [(0, 1, True), (1, 2, True)]),
            (2, [[[5.0], [6.0]], [[0.0], [0.0]]], [[5.0, 6.0]], [(0, 1, True)])]
    return spark.createDataFrame(rows, "eq long, waves array<array<array<float>>>, pos array<array<double>>, "
                                 "st array<struct<slot:int,p_pick:int,real:boolean>>")


def test_wide_steps_are_projections_of_their_own(spark):
    s = _samples(spark).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("sid", F.concat_ws("/", "eq", "copy"))
    s = with_slot_mask(s, "st", F.lit(1), [F.col("sid")], 3)
    out = s.select("eq", "copy", hidden_waveforms("waves", "hidden", F.lit(1), 3).alias("w"), hidden_positions("pos", "hidden", 3, 2).alias("p"))
    for r in out.collect():
        assert len(r["w"]) == 3 and len(r["p"]) == 3
        if r["eq"] == 1:  # the late station is hidden, the one left is never drawn
            assert r["w"] == [[[1.0], [0.0]], [[0.0], [0.0]], [[0.0], [0.0]]] and r["p"] == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]]
        else:
            assert r["w"] == [[[5.0], [0.0]], [[0.0], [0.0]], [[0.0], [0.0]]] and r["p"] == [[5.0, 6.0], [0.0, 0.0], [0.0, 0.0]]
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    drawn = [x for x in plan if "Project" in x and ("blind-pick" in x or "slice(waves" in x)]
    assert len(drawn) >= 2 and not any("*(" in x.split("Project")[0] for x in drawn)


def test_no_or_unknown_station_is_never_drawn(spark):
    t = "struct<slot:int,real:boolean>"
    rows = [("a", []), ("b", [(0, None)]), ("c", [(0, False), (1, True)]), ("d", None)]
    got = spark.createDataFrame(rows, f"k string, st array<{t}>").select("k", blinded_slots("st", [F.col("k")], 3).alias("g")).collect()
    assert all(not r["g"] for r in got)

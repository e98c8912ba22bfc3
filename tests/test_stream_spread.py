"""A micro-batch of few packed files is parsed and scored by all cores, and its lines are read as the JSON source reads them."""

import gzip
import json
import os
import threading
import time
import uuid

from pyspark.sql import functions as F

from quakeframe.operators.scoring import AttenuationScorer
from quakeframe.schema import SNAPSHOT_READ
from quakeframe.session import ship
from quakeframe.sources.snapshots_io import read_snapshots
from quakeframe.streaming.stream import Sinks, parse_lines, read_sinks, run_stream, stream_snapshots


def _line(i, **more):
    return json.dumps({"event_time": f"2000-01-01 00:00:{i:02d}", "waveform": [[[1.0, 2.0, 0.1 * i]] * 2],
                       "station": [[1.0 + i, 2.0, 3.0]], "eq_id": i, "mask_sec": 3} | more)


ODD = [_line(1), _line(2)[:60], "", "  \t", "[" + _line(3) + "," + _line(4) + "]", _line(5, waveform=None), _line(6, mask_sec="x"), "17",
       _line(7, station=[[None, 1.0, 2.0]]), '{"eq_id": 8}', "{}", _line(9, other=1), "  " + _line(10), "[]", "null", '"text"']


def test_lines_are_parsed_as_the_json_source_parses_them(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(ODD))
    want = read_snapshots(spark, str(tmp_path))
    got = parse_lines(spark.read.text(str(tmp_path)))
    assert got.columns == want.columns == SNAPSHOT_READ.names
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField") == 1  # each line once


def test_a_folder_names_the_horizon(spark, tmp_path):
    os.makedirs(tmp_path / "mask_sec=7")
    (tmp_path / "mask_sec=7" / "a.json").write_text(_line(1))
    q = stream_snapshots(spark, str(tmp_path), spread=3).writeStream.format("memory").queryName("horizon").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    rows = spark.table("horizon").collect()
    assert [(r["eq_id"], r["mask_sec"]) for r in rows] == [(1, 7)] and rows[0]["source_file"].endswith("a.json")
    assert stream_snapshots(spark, str(tmp_path)).schema["mask_sec"].dataType == SNAPSHOT_READ["mask_sec"].dataType


def test_one_packed_file_is_scored_by_several_tasks(spark, tmp_path):
    src, sink = tmp_path / "src", str(tmp_path / "sink")
    os.makedirs(src)
    with gzip.open(src / "a.json.gz", "wt") as f:
        f.write("\n".join([_line(i) for i in range(40)] + [_line(50)[:70]]))
    q = run_stream(spark, str(src), sink, str(tmp_path / "ckpt"), [AttenuationScorer(0.5, 0.3, "a")], max_files=1)
    q.awaitTermination()
    assert q.exception() is None
    got = read_sinks(spark, Sinks.at(sink))
    assert sorted(r["eq_id"] for r in got["predictions"].collect()) == list(range(40))
    assert got["predictions"].select(F.input_file_name()).distinct().count() > 1
    assert [r["reason"] for r in got["quarantine"].collect()] == ["corrupt"]
    report = got["report"].collect()
    assert [(r["n_snapshots"], r["n_rejected"], r["n_predictions"], len(r["files"])) for r in report] == [(40, 1, 40, 1)]


def test_streams_that_start_together_ship_the_package_once():
    sent = []

    class Context:
        applicationId = f"app-{uuid.uuid4().hex}"

        def addPyFile(self, path):
            time.sleep(0.5)
            sent.append(path)

    class Session:
        sparkContext = Context()

    threads = [threading.Thread(target=ship, args=(Session(),)) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(sent) == 1

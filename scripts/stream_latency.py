"""

Replay snapshots are derived from the test tables (test-year events, cut-offs 3/5/7/10 s)
and padded to the reference shape: 25 stations x 3000 samples x 3 components. They are
written as JSON, one file per snapshot group, then streamed ``max_files`` per trigger through
validation, Arrow scoring and the Parquet sink. Prints one JSON line with snapshots/s and
trigger-latency p50/p95.

Usage: python scripts/stream_latency.py [sf_dir] [files_per_trigger]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    from pyspark.sql import functions as F

    from quakeframe.operators import catalog as cat
    from quakeframe.operators.snapshots import assemble_snapshots, snapshot_ladder
    from quakeframe.plans.queries import models
    from quakeframe.session import get_session, shared_dir
    from quakeframe.sources import fixtures as fx
    from quakeframe.sources.snapshots_io import write_snapshots
    from quakeframe.streaming.stream import run_stream

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    per_trigger = int(sys.argv[2]) if len(sys.argv) > 2 else 1
    length, stations = 3000, 25
    spark = get_session(app_name="quakeframe-stream-latency")
    ids = cat.replay_event_ids(fx.fx_catalog(spark, sf_dir), fx.TEST_YEAR)
    lad = snapshot_ladder(fx.fx_traces(spark, sf_dir, fx.WAVE_PICK_DIVISOR), fx.fx_waveforms(spark, sf_dir), ids,
                          rate=fx.WAVE_RATE, length=length, max_station_num=stations)
    times = fx.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("eq_id"),
                                                          F.col("o_orderdate").alias("event_time"))
    snaps = assemble_snapshots(lad, times, max_station_num=stations, length=length)
    src, sink, ckpt = (shared_dir(spark, n) for n in ("lat-src", "lat-sink", "lat-ckpt"))
    n_snaps = snaps.count()
    files = max(1, min(64, n_snaps // 8))
    t0 = time.perf_counter()
    write_snapshots(snaps, src, partition_by=None, files_per_partition=files)
    t_write = time.perf_counter() - t0

    t0 = time.perf_counter()
    q = run_stream(spark, src, sink, ckpt, models(), max_files=per_trigger)
    q.awaitTermination()
    t_stream = time.perf_counter() - t0
    lat = sorted(p["durationMs"].get("triggerExecution", 0) / 1000 for p in q.recentProgress
                 if p.get("numInputRows", 0) > 0)
    n_pred = spark.read.parquet(sink).count()

    def pct(p):
        return round(lat[min(len(lat) - 1, int(p * len(lat)))], 3) if lat else None

    print(json.dumps({"sf_dir": sf_dir, "snapshot_shape": [stations, length, 3], "snapshots": n_snaps,
                      "files": files, "files_per_trigger": per_trigger, "batches": len(lat),
                      "predictions": n_pred, "write_sec": round(t_write, 2), "stream_sec": round(t_stream, 2),
                      "snapshots_per_sec": round(n_snaps / t_stream, 2) if t_stream else None,
                      "trigger_p50_sec": pct(0.5), "trigger_p95_sec": pct(0.95)}))
    spark.stop()


if __name__ == "__main__":
    main()

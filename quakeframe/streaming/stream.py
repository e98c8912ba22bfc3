"""Structured Streaming scoring of JSON snapshots (S2, S7, S10, F11, J8, P3, M8, ST1-ST4).

One source, one query, one writer. Snapshots are read with the fixed schema and validated;
valid ones are scored with self-targeting (the input stations are the targets) in an Arrow
``mapInArrow`` step, each real target becomes a row (kept by row, per snapshot; D5) with a
route instead of the reference's second, duplicate query (ST2). Every micro-batch feeds three
sinks under its batch id: predictions, the quarantine of invalid lines (D13), and a report
row, written last. A batch replayed after a failure replaces what it wrote before, so a
restarted query neither loses nor repeats anything, wherever it failed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quakeframe.operators.scoring import score
from quakeframe.schema import LOCAL_TZ, SNAPSHOT_READ
from quakeframe.sources.snapshots_io import validate_snapshots

DEFAULT_ROUTE = "other"
LINE_HEAD = 256  # characters of a line that decide which task parses it


def local_time(ts="event_time", naive: bool = False) -> Column:
    """M8: a UTC time shown as local (Asia/Taipei) text with second precision.

    ``naive=True`` for a ``TIMESTAMP_NTZ`` column holding UTC wall-clock time: converted
    with ``convert_timezone``. Instants (``TIMESTAMP``) go through the session's wall clock
    and back out of it. Neither result depends on the session time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    zone = F.lit("UTC") if naive else F.current_timezone()
    return F.date_format(F.convert_timezone(zone, F.lit(LOCAL_TZ), c.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")


def stream_snapshots(spark: SparkSession, source_dir: str, max_files: int = 1,
                     archive_dir: str | None = None, spread: int | None = None) -> DataFrame:
    """A streaming read of a folder of snapshot JSON files, ``max_files`` per trigger.

    Each line names its ``source_file``. With ``archive_dir``, the source moves consumed files there
    (S7) instead of deleting folders: those of a batch when the next one starts, so the last
    batch's stay until ``archive_consumed``.

    Lines are read as text and parsed as the JSON source does. A packed file is read by one task; with
    ``spread`` its lines are dealt to so many tasks before they are parsed. Lines that begin
    alike (the horizons of an event) stay together, so that the dealing packs them well."""
    r = spark.readStream.format("text").option("maxFilesPerTrigger", int(max_files))
    if archive_dir:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    lines = r.load(source_dir).withColumn("source_file", F.col("_metadata.file_path"))
    if spread:
        lines = lines.repartition(int(spread), F.substring("value", 1, LINE_HEAD))
    return parse_lines(lines)


def parse_lines(lines: DataFrame, schema: T.StructType = SNAPSHOT_READ) -> DataFrame:
    """The snapshots of text lines (``value``), as the JSON source reads them: no row for an empty line, one
    per element of an array, the text of a line that does not parse in ``_corrupt_record``. The other
    columns stay; one named like a field (a folder's ``mask_sec=3``) replaces it."""
    text, kept = F.col("value"), [c for c in lines.columns if c != "value"]
    many = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))
    # Empty lines go by their text: a filter on what was parsed would parse each line twice.
    rows = lines.filter(text.rlike(r"[^ \t\r\n]")).select(*kept, F.explode(F.coalesce(many, F.array(text))).alias("value"))
    rows = rows.select(*kept, "value", F.from_json("value", schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}).alias("_s"))
    fields = {f.name: F.col("_s")[f.name] for f in schema.fields}
    fields["_corrupt_record"] = F.when(F.col("_s").isNull(), text).otherwise(fields["_corrupt_record"])
    fields |= {f.name: F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in kept}
    return rows.select(*[c.alias(n) for n, c in fields.items()], *[c for c in kept if c not in fields])


def self_targets(station: str = "station") -> Column:
    """J8 + F9: the snapshot's own stations as targets, keeping only real ones (not all
    coordinates zero: a sea-level station is real; D5)."""
    st = F.col(station)
    tg = F.transform(st, lambda p, i: F.struct(
        i.cast("int").alias("slot"), p[0].cast("double").alias("lat"), p[1].cast("double").alias("lon"),
        p[2].cast("double").alias("elev")))
    return F.filter(tg, lambda t: ~((t["lat"] == 0) & (t["lon"] == 0) & (t["elev"] == 0)))


def score_snapshots(snaps: DataFrame, scorers: list, key_cols=("eq_id", "mask_sec", "event_time")) -> DataFrame:
    """One row per (snapshot, real target, model) with the mixture mean.

    Works on batch and streaming DataFrames alike. Invalid snapshots are dropped here; use
    ``quarantine`` to keep them. A frame that was validated already is not validated again."""
    keys = [k for k in key_cols if k in snaps.columns]
    checked = snaps if {"valid", "reason"} <= set(snaps.columns) else validate_snapshots(snaps, n_stations=None)
    rows = checked.filter(F.col("valid")).select(*keys, "waveform", "station", self_targets().alias("targets"))
    scored = score(rows, scorers, keys, target_pos=("lat", "lon", "elev"), mixture=False)
    return scored.select(*keys, "model", F.col("target.slot").alias("slot"),
                         F.col("target.lat").alias("latitude"), F.col("target.lon").alias("longitude"),
                         F.col("target.elev").alias("elevation"), "predict")


def quarantine(snaps: DataFrame, n_stations: int | None = None) -> DataFrame:
    """Invalid snapshots with their reason."""
    return validate_snapshots(snaps, n_stations=n_stations).filter(~F.col("valid"))


def route_targets(preds: DataFrame, rules: list[tuple[str, float, float]], default: str = DEFAULT_ROUTE) -> DataFrame:
    """ST2: a ``route`` per target from a static rule list ``(name, lat_min, lat_max)``
    (first match wins), compiled to one CASE expression instead of a second query."""
    expr = None
    for name, lo, hi in rules:
        cond = (F.col("latitude") >= lo) & (F.col("latitude") < hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = F.lit(default) if expr is None else expr.otherwise(F.lit(default))
    return preds.withColumn("route", expr)


def rule_segments(rules: DataFrame) -> DataFrame:
    """Disjoint latitude segments (lo, hi, route) of a rule table ``priority, name, lat_min,
    lat_max`` (NULL or infinite: unbounded): between two neighbouring bounds of any rules, the matching
    rule with the smallest priority (then name) wins. All steps are on the rule table alone."""
    inf = F.lit(float("inf"))
    r = rules.select("priority", "name", F.coalesce("lat_min", -inf).alias("a"), F.coalesce("lat_max", inf).alias("b")).filter("a < b")
    bounds = r.select(F.explode(F.array("a", "b")).alias("lo")).distinct()
    bounds = bounds.withColumn("hi", F.lead("lo").over(Window.orderBy("lo"))).filter("hi is not null")
    first = F.min(F.struct("priority", "name")).alias("w")
    return bounds.join(r, (F.col("a") <= F.col("lo")) & (F.col("lo") < F.col("b"))).groupBy("lo", "hi").agg(first).select(
        "lo", "hi", F.col("w.name").alias("route"))


def route_by_table(preds: DataFrame, rules: DataFrame, default: str = DEFAULT_ROUTE) -> DataFrame:
    """ST2: a ``route`` per target from a rule table with overlapping rules; the first match (by
    priority) wins. The rules become disjoint segments, so a target meets one at most and no
    second step has to choose. Segments are dealt to cells of one degree: the join is an equi
    join on the cell with the bounds as a filter, which Spark broadcasts while the segments are
    small, and shuffles otherwise. Targets without a latitude or a match get ``default``."""
    cell = lambda c: F.greatest(F.least(F.floor(c), F.lit(91)), F.lit(-91)).cast("int")
    low = F.greatest(F.col("lo"), F.lit(-91.0))  # floor of an infinite bound is none
    high = F.least(F.col("hi"), F.lit(91.0))
    parts = rule_segments(rules).withColumn("cell", F.explode(F.sequence(cell(F.least(low, F.lit(91.0))), cell(F.greatest(high, F.lit(-91.0))))))
    parts = parts.select(F.col("cell").alias("_cell"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("route").alias("_route"))
    lat = F.col("latitude")
    p = preds.withColumn("_c", F.when(~F.isnan(lat), cell(F.greatest(F.least(lat, F.lit(91.0)), F.lit(-91.0)))))
    out = p.join(parts, (F.col("_c") == F.col("_cell")) & (lat >= F.col("_lo")) & ((lat < F.col("_hi")) | (F.col("_hi") == float("inf"))), "left")
    return out.withColumn("route", F.coalesce("_route", F.lit(default))).drop("_c", "_cell", "_lo", "_hi", "_route")


@dataclass(frozen=True)
class Sinks:
    """The folders of a stream: ``.../batch_id=<id>`` below each."""

    predictions: str
    quarantine: str
    report: str

    @staticmethod
    def at(sink_dir: str, quarantine_dir: str | None = None, report_dir: str | None = None) -> "Sinks":
        base = sink_dir.rstrip("/")
        return Sinks(base, quarantine_dir or f"{base}-quarantine", report_dir or f"{base}-report")


PREDICTIONS_SINK = ("eq_id long, mask_sec int, event_time timestamp, model string, slot int, latitude double, longitude double, "
                    "elevation double, predict double, output_time string, batch_id long, route string")
QUARANTINE_SINK = "eq_id long, mask_sec int, event_time timestamp, reason string, _corrupt_record string, batch_id long"
REPORT_SINK = ("n_snapshots long, n_rejected long, files array<string>, n_predictions long, output_time string, "
               "batch_id long")


def read_sinks(spark: SparkSession, sinks: Sinks) -> dict[str, DataFrame]:
    """What a stream has written, by sink; empty frames where no batch wrote a row."""
    kinds = {"predictions": PREDICTIONS_SINK, "quarantine": QUARANTINE_SINK, "report": REPORT_SINK}
    return {k: spark.read.schema(schema).parquet(getattr(sinks, k)) for k, schema in kinds.items()}


def run_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, scorers: list,
               rules=None, max_files: int = 1, trigger: dict | None = None, archive_dir: str | None = None,
               quarantine_dir: str | None = None, report_dir: str | None = None, name: str | None = None,
               on_written: Callable[[str, int], None] | None = None) -> StreamingQuery:
    """ST1/ST3/S10: start the scoring query. Whatever the options, predictions (with route and
    output time), quarantine and report have the same schemas and folders per batch; the
    quarantine and the report lie beside the sink unless named.

    ``rules``: a list for ``route_targets``, or the path of a rule table for ``route_by_table``,
    read again for every batch. ``trigger`` is passed to ``DataStreamWriter.trigger`` (default
    ``availableNow``; ``{"processingTime": "5 seconds"}`` for a live feed). ``on_written(sink,
    batch_id)`` is told of each sink a batch has written; an error in it fails the batch. A batch of
    fewer files than cores is dealt to all of them. Wait with ``await_all`` or ``supervise``, so any failing query is seen (ST4)."""
    cores = spark.sparkContext.defaultParallelism
    snaps = stream_snapshots(spark, source_dir, max_files, archive_dir, spread=cores if max_files < cores else None)
    sinks = Sinks.at(sink_dir, quarantine_dir, report_dir)

    def routed(preds):
        if isinstance(rules, str):
            return route_by_table(preds, preds.sparkSession.read.parquet(rules))
        return route_targets(preds, rules or [])

    def write_batch(batch, batch_id):
        def put(kind, rows, by=()):
            path = f"{getattr(sinks, kind)}/batch_id={batch_id}"
            rows.write.mode("overwrite").partitionBy(*by).parquet(path)
            if on_written:
                on_written(kind, batch_id)
            return path

        checked = validate_snapshots(batch, n_stations=None).persist()
        now = local_time(F.current_timestamp())
        try:
            preds = routed(score_snapshots(checked, scorers)).withColumn("output_time", now)
            path = put("predictions", preds, ["route"])
            put("quarantine", checked.filter(~F.col("valid")).select("eq_id", "mask_sec", "event_time", "reason", "_corrupt_record"))
            n = batch.sparkSession.read.schema(preds.schema).parquet(path).count()
            put("report", checked.agg(F.count(F.when(F.col("valid"), 1)).alias("n_snapshots"),
                                      F.count(F.when(~F.col("valid"), 1)).alias("n_rejected"),
                                      F.collect_set("source_file").alias("files"))  # at most max_files
                .withColumn("n_predictions", F.lit(n).cast("long")).withColumn("output_time", now))
        finally:
            checked.unpersist()

    w = snaps.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(write_batch)
    w = w.queryName(name) if name else w
    return w.trigger(**(trigger or {"availableNow": True})).start()


def archive_consumed(spark: SparkSession, sinks: Sinks, archive_dir: str) -> int:
    """Move the input files of all reported batches below ``archive_dir`` (by their whole path)
    and return how many were moved. A batch is reported last, so a file whose batch has to be
    run again is still in place; files moved before are skipped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path_of = jvm.org.apache.hadoop.fs.Path
    moved = 0
    files = read_sinks(spark, sinks)["report"].select(F.explode("files").alias("f")).distinct()
    for row in files.toLocalIterator():
        src = path_of(jvm.java.net.URI(row["f"]))
        fs = src.getFileSystem(conf)
        if fs.exists(src):
            to = path_of(archive_dir.rstrip("/") + src.toUri().getPath())
            fs.mkdirs(to.getParent())
            moved += bool(fs.rename(src, to))
    return moved


def run_stream_reported(spark: SparkSession, source_dir: str, sink_dir: str, report_dir: str,
                        checkpoint_dir: str, scorers: list, max_files: int = 1, trigger: dict | None = None,
                        quarantine_dir: str | None = None) -> StreamingQuery:
    """``run_stream`` with the report in a folder of its own."""
    return run_stream(spark, source_dir, sink_dir, checkpoint_dir, scorers, max_files=max_files, trigger=trigger,
                      quarantine_dir=quarantine_dir, report_dir=report_dir)


def await_all(spark: SparkSession, timeout: float | None = None) -> None:
    """ST4: wait on every active query at once, so a failure in any of them surfaces
    (instead of blocking on the first query while the second one has died)."""
    while spark.streams.active:
        if timeout is None:
            spark.streams.awaitAnyTermination()
        elif not spark.streams.awaitAnyTermination(timeout):
            return
        for q in spark.streams.active:
            if q.exception() is not None:
                raise RuntimeError(str(q.exception()))
        spark.streams.resetTerminated()


def _idle(q: StreamingQuery) -> bool:
    """Whether a live query has looked for files and found no more."""
    s = q.status
    return s["message"].startswith("Waiting for") and not s["isDataAvailable"] and not s["isTriggerActive"]


def supervise(spark: SparkSession, queries: dict[str, StreamingQuery], timeout: float, poll: float = 0.1) -> DataFrame:
    """ST3/ST4: watch several running queries until each has died, ended or used up its source
    (or ``timeout`` seconds have passed), then stop those that still run. Returns the status
    table: name, state (``failed``, ``ended``, ``idle`` or, at the timeout, ``running``),
    last_batch (NULL before the first) and error. One that dies neither hides behind the
    others nor ends them."""
    end = time.monotonic() + timeout
    while time.monotonic() < end and any(q.isActive and not _idle(q) for q in queries.values()):
        time.sleep(poll)
    rows = []
    for name, q in queries.items():
        error, active = q.exception(), q.isActive
        state = "failed" if error is not None else "ended" if not active else "idle" if _idle(q) else "running"
        progress = q.lastProgress
        rows.append((name, state, progress["batchId"] if progress else None, str(error) if error is not None else None))
        if active:
            q.stop()
    spark.streams.resetTerminated()  # told here: a later wait on other queries is not to raise it again
    return spark.createDataFrame(rows, "name string, state string, last_batch long, error string")

"""Snapshot JSON (S1, S6, C12) and prediction CSV (S8, S9) sources and sinks.

Writers go through Spark's file commit protocol (files appear atomically; D14), into a
folder the caller names (on a cluster: below the shared ``spark.checkpoint.dir``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.schema import PREDICTIONS_CSV, SNAPSHOT, SNAPSHOT_READ

FAST = {"zlib.compress.level": "BEST_SPEED"}  # gzipped lines: a fifth longer, in less than two thirds of the time


def write_snapshots(snaps: DataFrame, path: str, partition_by: str | None = "mask_sec",
                    files_per_partition: int | None = None, compression: str | None = None) -> None:
    """One JSON line per snapshot ``{event_time, waveform, station, eq_id}``.

    ``compression``: a codec of Spark's text files (``gzip``, ``bzip2``), which every reader here
    knows by the file's name; the horizons of an event, beside each other, mostly repeat the same samples.
    Timestamps are written as ``yyyy-MM-dd HH:mm:ss`` (the reference text format)."""
    extra = [c for c in ("eq_id", "mask_sec") if c in snaps.columns]
    out = snaps.select(F.col("event_time").cast("timestamp").alias("event_time"), "waveform", "station", *extra)
    if files_per_partition:
        out = out.repartition(files_per_partition)
    w = (out.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"))
    if compression:
        w = w.option("compression", compression).options(**FAST)
    if partition_by and partition_by in out.columns:
        w = w.partitionBy(partition_by)
    w.json(path)


def read_snapshots(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Batch read with the fixed snapshot schema. Malformed lines are kept, with their
    text in ``_corrupt_record``, for ``validate_snapshots``."""
    schema = SNAPSHOT_READ if with_ids else SNAPSHOT
    r = (spark.read.schema(schema).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt_record")
         .option("timestampFormat", "yyyy-MM-dd HH:mm:ss"))
    return r.json(path)


def identify_snapshots(snaps: DataFrame) -> DataFrame:
    """Event and cut-off of lines that do not name them, from the file they were read from
    (``{eq_id}_{mask_sec}_sec.json``, as file or folder name)."""
    path, out = F.col("_metadata.file_path"), snaps
    for i, (name, kind) in enumerate((("eq_id", "long"), ("mask_sec", "int")), 1):
        found = F.regexp_extract(path, r"(\d+)_(\d+)_sec\.json[^/]*(?:/[^/]*)?$", i)
        found = F.when(found != "", found).cast(kind)
        out = out.withColumn(name, F.coalesce(F.col(name), found) if name in snaps.columns else found)
    return out


def validate_snapshots(snaps: DataFrame, n_stations: int | None = 25, length: int | None = None) -> DataFrame:
    """Add ``valid`` and ``reason``. A snapshot is valid when it parsed, has
    ``n_stations`` station rows in both arrays, every trace has the same number of samples
    (``length`` if given) of 3 components, positions are 3 or 4 wide, and no element is NULL.
    Invalid rows go to a quarantine sink instead of failing the model call."""
    w, st = F.col("waveform"), F.col("station")
    corrupt = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in snaps.columns else F.lit(False)
    t0 = F.size(w[0])
    ragged_time = F.exists(w, lambda tr: tr.isNull() | (F.size(tr) != t0))
    bad_comp = F.exists(w, lambda tr: F.exists(tr, lambda s: s.isNull() | (F.size(s) != 3)
                                               | F.exists(s, lambda x: x.isNull())))
    bad_pos = F.exists(st, lambda p: p.isNull() | ~F.size(p).isin(3, 4) | F.exists(p, lambda x: x.isNull()))
    reason = (F.when(corrupt, F.lit("corrupt"))
              .when(w.isNull() | st.isNull(), F.lit("missing"))
              .when(F.size(w) != F.size(st), F.lit("station_count_mismatch")))
    if n_stations is not None:
        reason = reason.when(F.size(w) != int(n_stations), F.lit("station_count"))
    reason = reason.when(ragged_time, F.lit("ragged_time"))
    if length is not None:
        reason = reason.when(t0 != int(length), F.lit("length"))
    reason = reason.when(bad_comp, F.lit("bad_component")).when(bad_pos, F.lit("bad_position"))
    return snaps.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def write_predictions(preds: DataFrame, path: str, partition_by=("model", "mask_sec"), compression: str | None = None) -> None:
    """CSV with header, one folder per model (and cut-off, when present); ``compression`` as in
    ``write_snapshots``."""
    cols = [f.name for f in PREDICTIONS_CSV.fields if f.name in preds.columns]
    extra = [c for c in partition_by if c in preds.columns and c not in cols]
    (preds.select(*cols, *extra).write.mode("overwrite").option("header", True).option("compression", compression or "none")
     .partitionBy(*[c for c in partition_by if c in preds.columns]).csv(path))


def read_predictions(spark: SparkSession, path: str, with_cutoff: bool = False) -> DataFrame:
    """Read prediction CSVs back with an explicit schema (no inference); ``with_cutoff``
    when they were written per cut-off (the ``mask_sec`` folders)."""
    from pyspark.sql import types as T

    data_fields = [f for f in PREDICTIONS_CSV.fields if f.name != "model"]
    schema = T.StructType(data_fields + [T.StructField("model", T.StringType(), True)])
    if with_cutoff:
        schema = schema.add("mask_sec", T.IntegerType())
    return spark.read.schema(schema).option("header", True).csv(path)

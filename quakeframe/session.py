"""Session construction for tests and the bench, and the shared working folder.

Library functions never build a session or set a master: they take the caller's
``SparkSession``. ``get_session`` is a convenience for tests, the bench and scripts.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at cluster scale (see README "Scale notes").
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot event even where the split costs the partitioning that a later step would reuse.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Broadcast decided on the runtime-measured size of a finished stage (a checked bound).
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    # Runtime Bloom filters: the wide waveform scan is filtered by the (much smaller) set of
    # chunk-0 trace keys before it is shuffled for the hydration join.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
    # Checkpoint files of pinned rankings are removed once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A full-shape input set is ~900 kB; 64 rows keep an Arrow batch near 60 MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
}


def _driver_memory() -> str:
    """QF_DRIVER_MEMORY, else 60% of the machine's memory capped at 16g (local mode: the
    driver heap is the whole engine, and a heap larger than the container gets it killed)."""
    if os.environ.get("QF_DRIVER_MEMORY"):
        return os.environ["QF_DRIVER_MEMORY"]
    try:
        with open("/proc/meminfo") as f:
            kb = int(next(line for line in f if line.startswith("MemTotal")).split()[1])
        limit = None
        for cg in ("/sys/fs/cgroup/memory.max", "/sys/fs/cgroup/memory/memory.limit_in_bytes"):
            if os.path.exists(cg):
                raw = open(cg).read().strip()
                if raw.isdigit():
                    limit = int(raw) // 1024
        if limit:
            kb = min(kb, limit)
        return f"{max(1, min(16, int(kb * 0.6 / 1024 / 1024)))}g"
    except (OSError, StopIteration, ValueError):
        return "4g"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quakeframe") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or f"local[{cpus}]")
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", _driver_memory())
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; create one only in local mode.

    On a cluster ``spark.checkpoint.dir`` (or ``SparkContext.setCheckpointDir``) must name a
    folder that driver and executors share; without it this raises, since a folder of the
    driver's own machine would lose data. In local mode a fresh folder under /tmp serves.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="qf-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder (for written tables,
    stream sources, sinks and checkpoints). Never a machine-local temp folder on a cluster."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/qf-{name}-{uuid.uuid4().hex[:12]}"


PACKED = "zstd"  # of tables that are kept for later steps


def pinned(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet into the shared folder and read back: later steps prune
    columns, lineage is cut, and a lost executor costs only a new read."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, compression=PACKED)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()
_shipping = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors once per application, as ``--py-files`` would: Spark
    serves the archive from the driver, so no executor needs an installed copy."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    with _shipping:  # streams score in threads of their own, and Spark takes an archive of a name once
        if sc.applicationId in _shipped or not os.path.isdir(root):
            return
        path = os.path.join(tempfile.mkdtemp(prefix="qf-py-"), f"{os.path.basename(root)}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)

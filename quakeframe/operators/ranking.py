"""Position of a row inside its group, without sending a whole group to one task.

A plain ``row_number() OVER (PARTITION BY eq_id ...)`` puts every row of an event into one
task; if one event holds a third of all traces that task holds a third of the data. One path
serves groups of every size:

1. range-partition on the full sort key (group key + order columns) and sort within
   partitions: a large group is spread over many partitions, small ones share them;
2. number the rows of a group within their partition: the tagged rows are kept as a table
   bucketed by partition, so this window shuffles nothing;
3. only the first and the last group of a partition can go on in another one: the pieces of these
   (at most two a partition) are counted, and a running sum over a group's pieces gives the
   offset of each; this small table is broadcast, and position = offset + rank inside the piece.

The order columns must make the order total (they end with the trace key). The range
bounds come from sampling, and the sample depends on the order in which shuffle blocks
arrive, so two computations of the range exchange can cut the data differently. The tagged
rows are therefore written once as Parquet into the cluster's shared checkpoint folder: both
consumers read the same files (each only the columns it needs), and a lost executor cannot
make them disagree (it also cuts the lineage of the upstream plan).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.session import PACKED, pinned, shared_dir


def group_positions(df: DataFrame, keys: list[str], order: list[Column | str],
                    pos_col: str = "pos", size_col: str | None = "group_size",
                    num_partitions: int | None = None, pos_type: str = "int") -> DataFrame:
    """Add ``pos_col`` (0-based position in the group under ``order``, as ``pos_type``) and
    optionally ``size_col`` (rows in the group)."""
    sort_key = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    n = num_partitions or _shuffle_partitions(df)
    rows = (df.repartitionByRange(n, *sort_key).sortWithinPartitions(*sort_key)
            .withColumn("__qf_part", F.spark_partition_id())
            .withColumn("__qf_rid", F.monotonically_increasing_id()))
    tagged = _kept_by_partition(rows, n)
    pieces = _split_groups(tagged, keys)
    own = Window.partitionBy(*keys, "__qf_slot")
    out = tagged.withColumn("__qf_pos", F.row_number().over(own.orderBy("__qf_rid")) - 1)
    if size_col:
        out = out.withColumn("__qf_size", F.count(F.lit(1)).over(own))
    same = F.col("__qf_slot") == F.col("__qf_at")
    for k in keys:  # rows without a key are a group of their own
        same = same & F.col(k).eqNullSafe(F.col(f"__qf_{k}"))
    out = out.join(F.broadcast(pieces), same, "left")
    out = out.withColumn(pos_col, (F.col("__qf_pos") + F.coalesce("__qf_before", F.lit(0))).cast(pos_type))
    if size_col:
        out = out.withColumn(size_col, F.coalesce("__qf_all_rows", "__qf_size"))
    return out.select(*[c for c in df.columns if c not in (pos_col, size_col)], *([size_col] if size_col else []), pos_col)


def _kept_by_partition(rows: DataFrame, n: int) -> DataFrame:
    """The rows written once, as a table bucketed by ``__qf_slot``, a number for each partition whose bucket
    no other partition has: a window within a partition then reads its file and shuffles nothing."""
    spark = rows.sparkSession
    tries = spark.range(64 * n + 64).select(F.col("id").cast("int").alias("slot"))
    taken = tries.groupBy(F.pmod(F.hash("slot"), F.lit(n)).alias("bucket")).agg(F.min("slot").alias("slot")).collect()
    free = {r["bucket"]: r["slot"] for r in taken}
    slots = F.array(*[F.lit(free.get(i, -1 - i)) for i in range(n)])  # without a bucket of its own: any
    name = f"qf_ranked_{uuid.uuid4().hex}"
    (rows.withColumn("__qf_slot", F.element_at(slots, F.col("__qf_part") + 1)).drop("__qf_part")
     .write.format("parquet").option("compression", PACKED).option("path", shared_dir(spark, "ranked")).bucketBy(n, "__qf_slot").saveAsTable(name))
    return spark.table(name)


def _split_groups(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces of the groups that lie in several partitions, with the rows before them and in the whole group.
    Such a group is the last of one partition and the first of another, so there are
    at most two groups and two pieces a partition."""
    key = F.struct(*keys)
    ends = tagged.groupBy("__qf_slot").agg(F.min_by(key, "__qf_rid").alias("a"), F.max_by(key, "__qf_rid").alias("b"))
    ends = ends.select(F.explode(F.array("a", "b")).alias("k")).select(*[F.col("k")[k].alias(f"__qf_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__qf_{k}"))
        same = one if same is None else same & one
    names = [f"__qf_{k}" for k in keys]
    pieces = (tagged.select(*keys, "__qf_slot", "__qf_rid").join(F.broadcast(ends), same)
              .groupBy(*names, "__qf_slot").agg(F.count(F.lit(1)).alias("n"), F.min("__qf_rid").alias("first")))
    w = Window.partitionBy(*names)
    pieces = pieces.select(
        *names, F.col("__qf_slot").alias("__qf_at"), "n", F.sum("n").over(w).alias("__qf_all_rows"),
        F.coalesce(F.sum("n").over(w.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__qf_before"))
    return pinned(pieces.filter(F.col("__qf_all_rows") > F.col("n")).drop("n"), "pieces")


def _shuffle_partitions(df: DataFrame) -> int:
    raw = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    try:
        return max(1, int(raw))
    except ValueError:  # e.g. "auto" on some platforms
        return max(1, df.sparkSession.sparkContext.defaultParallelism)

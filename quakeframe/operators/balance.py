"""Label balancing: class histogram (A1) and inverse-frequency weights (A2).

The histogram has at most 9 rows whatever the data size, so joining it back is a
broadcast of a table with a proven size bound (not a window over 8 huge partitions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.functions.intensity import intensity8


def class_histogram(traces: DataFrame, label: str = "pga") -> DataFrame:
    """A1: number of traces per 8-class intensity (map-side combined)."""
    return (traces.select(intensity8(label, label if label in ("pga", "pgv") else "pga").alias("class"))
            .groupBy("class").agg(F.count(F.lit(1)).alias("n")))


def label_weights(traces: DataFrame, label: str = "pga") -> DataFrame:
    """A2: ``weight = 1 / count(class)`` per trace, classes counted on these rows (before
    any trace copies are made, so copies inherit their trace's weight; D8)."""
    kind = label if label in ("pga", "pgv") else "pga"
    t = traces.withColumn("class", intensity8(label, kind))
    hist = t.groupBy(F.col("class").alias("_class")).agg(F.count(F.lit(1)).alias("_class_n"))
    # Null-safe: traces without a label form a class of their own.
    return (t.join(F.broadcast(hist), F.col("class").eqNullSafe(F.col("_class")))
            .withColumn("weight", F.lit(1.0) / F.col("_class_n")).drop("_class", "_class_n"))

"""Intensity classes as generated ``CASE WHEN`` columns (stay inside whole-stage codegen).

Labels are log10 values. NaN or NULL input gives a NULL class (D15); a value below the
first bound is class 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeframe.functions.portable import is_number
from quakeframe.schema import (INTENSITY8_PGA, INTENSITY8_PGV, INTENSITY10_LABELS, INTENSITY10_PGA,
                               INTENSITY10_PGV)

LOG_PGA10 = [math.log10(v) for v in INTENSITY10_PGA]
LOG_PGV10 = [math.log10(v) for v in INTENSITY10_PGV]
LOG_PGA8 = [math.log10(v) for v in INTENSITY8_PGA]
LOG_PGV8 = [math.log10(v) for v in INTENSITY8_PGV]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bisect_class(x: Column, bounds: list[float]) -> Column:
    """Number of bounds <= x, minus one, clamped at 0 (``bisect_right(bounds, x) - 1``)."""
    expr = F.lit(0)
    for i, b in enumerate(bounds[1:], start=1):
        expr = F.when(x >= F.lit(b), F.lit(i)).otherwise(expr)
    return F.when(is_number(x), expr)


def intensity10(pga, pgv=None) -> Column:
    """M1/M2: 10-class intensity of log10 PGA; with PGV, above class bound 5 (strictly) the
    higher of the PGA and PGV classes."""
    pga = _col(pga)
    cls = _bisect_class(pga, LOG_PGA10)
    if pgv is None:
        return cls
    pgv = _col(pgv)
    pgv_cls = _bisect_class(pgv, LOG_PGV10)
    escalate = is_number(pga) & (pga > F.lit(LOG_PGA10[5])) & is_number(pgv)
    return F.when(escalate, F.greatest(cls, pgv_cls)).otherwise(cls)


def intensity_label(cls) -> Column:
    """Text label of a 10-class intensity."""
    return F.element_at(F.array(*[F.lit(s) for s in INTENSITY10_LABELS]), _col(cls) + 1)


def intensity8(x, label: str = "pga") -> Column:
    """M3: 8-class intensity used for label balancing; lower bound inclusive."""
    bounds = LOG_PGA8 if label == "pga" else LOG_PGV8
    x = _col(x)
    expr = F.lit(0)
    for i, b in enumerate(bounds, start=1):
        expr = F.when(x >= F.lit(b), F.lit(i)).otherwise(expr)
    return F.when(is_number(x), expr)


def scale_table(spark: SparkSession) -> DataFrame:
    """The 10-class scale for both targets with tick positions and display lines.

    20 rows (bounded). Tick i is the midpoint of bounds i and i+1; the last tick is
    extrapolated as ``2*tick_8 - tick_7``. Bounds 3..8 are drawn as threshold lines.
    """
    rows = []
    for target, bounds in (("pga", LOG_PGA10), ("pgv", LOG_PGV10)):
        for i, b in enumerate(bounds):
            rows.append((target, i, INTENSITY10_LABELS[i], float(b)))
    df = spark.createDataFrame(rows, "target string, class int, label string, threshold double")
    w = Window.partitionBy("target").orderBy("class")
    nxt = F.lead("threshold").over(w)
    mid = (F.col("threshold") + nxt) / 2
    df = df.withColumn("_mid", mid)
    prev1 = F.lag("_mid", 1).over(w)
    prev2 = F.lag("_mid", 2).over(w)
    return (df.withColumn("tick", F.when(F.col("_mid").isNotNull(), F.col("_mid"))
                          .otherwise(prev1 * 2 - prev2))
            .withColumn("display_line", (F.col("class") >= 3) & (F.col("class") <= 8))
            .drop("_mid"))

"""Column helpers whose results are identical across engines and stable under retries.

* ``hash_uniform``: a deterministic pseudo-random number in [0, 1) from key columns and a
  salt. It replaces the reference's seeded/unseeded NumPy and pandas draws: it does not
  depend on partitioning, ordering or task retries, so recomputation after an executor
  loss gives the same rows. Same value in SQL: ``('0x' || substr(md5(s),1,8))::BIGINT / 2^32``.
* NaN-aware comparisons: Spark orders NaN above every number, pandas/NumPy compare it as
  false. Every comparison on magnitudes, labels and predictions goes through these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_uniform(*keys, salt: str = "") -> Column:
    parts = [_col(k).cast("string") for k in keys] + [F.lit(salt)]
    hexed = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(hexed, 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def is_number(c) -> Column:
    """True for a non-null, non-NaN value."""
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c)


def ge(c, v) -> Column:
    c = _col(c)
    return is_number(c) & (c >= v)


def gt(c, v) -> Column:
    c = _col(c)
    return is_number(c) & (c > v)


def lt(c, v) -> Column:
    c = _col(c)
    return is_number(c) & (c < v)

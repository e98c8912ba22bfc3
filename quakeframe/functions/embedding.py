"""C11: sinusoidal position embedding of (lat, lon, depth) as one array expression per row.

Output position j (``emb_dim`` wide, ``emb_dim % 10 == 0``):
``j%5 == 0`` sin(lat * c_lat[j//5]), ``1`` cos(lat ...), ``2`` sin(lon * c_lon[j//5]),
``3`` cos(lon ...), ``j%10 == 4`` sin(depth * c_depth[j//10]), ``9`` cos(depth ...), with
``c[i] = 2*pi/min * (min/max) ** (i/dim)``; dim = emb/5 for lat and lon, emb/10 for depth.
Vs30 is not embedded. Computed in double precision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quakeframe.schema import EMB_DIM, EMB_WAVELENGTHS


def _coef(idx: Column, lo: float, hi: float, dim: int) -> Column:
    return F.lit(2 * math.pi / lo) * F.pow(F.lit(lo / hi), idx.cast("double") / F.lit(float(dim)))


def embedding_value(lat: Column, lon: Column, depth: Column, j: Column, emb_dim: int = EMB_DIM) -> Column:
    (la0, la1), (lo0, lo1), (de0, de1) = EMB_WAVELENGTHS
    d5, d10 = emb_dim // 5, emb_dim // 10
    i5 = F.floor(j / 5)
    i10 = F.floor(j / 10)
    a_lat = lat * _coef(i5, la0, la1, d5)
    a_lon = lon * _coef(i5, lo0, lo1, d5)
    a_dep = depth * _coef(i10, de0, de1, d10)
    r5 = j % 5
    return (F.when(r5 == 0, F.sin(a_lat)).when(r5 == 1, F.cos(a_lat))
            .when(r5 == 2, F.sin(a_lon)).when(r5 == 3, F.cos(a_lon))
            .when(j % 10 == 4, F.sin(a_dep)).otherwise(F.cos(a_dep)))


def position_embedding(lat="lat", lon="lon", depth="elev", emb_dim: int = EMB_DIM) -> Column:
    """``array<double>`` of length ``emb_dim`` for each row."""
    if emb_dim % 10:
        raise ValueError("emb_dim must be a multiple of 10")
    la, lo, de = (F.col(c) if isinstance(c, str) else c for c in (lat, lon, depth))
    return F.transform(F.sequence(F.lit(0), F.lit(emb_dim - 1)),
                       lambda j: embedding_value(la.cast("double"), lo.cast("double"), de.cast("double"), j, emb_dim))

"""Gaussian-mixture outputs as column expressions: parameters from raw outputs (M7), the
mixture mean (A6) and the exceedance probability (M5).

A mixture is ``array<struct<weight, mu, sigma>>`` (one struct per component).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 approximation of erf (|error| <= 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def erf(x: Column) -> Column:
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * ax)
    a1, a2, a3, a4, a5 = ERF_A
    poly = t * (F.lit(a1) + t * (F.lit(a2) + t * (F.lit(a3) + t * (F.lit(a4) + t * F.lit(a5)))))
    y = F.lit(1.0) - poly * F.exp(-ax * ax)
    return F.when(x < 0, -y).otherwise(y)


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(z / F.lit(math.sqrt(2.0))))


def mixture_from_logits(logits, log_sigma, mu) -> Column:
    """M7: softmax weights (max-shifted), ``exp`` sigma, linear mu -> mixture array."""
    lg = F.transform(_col(logits), lambda x: x.cast("double"))
    m = F.array_max(lg)
    e = F.transform(lg, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    w = F.transform(e, lambda x: x / s)
    sg = F.transform(_col(log_sigma), lambda x: F.exp(x.cast("double")))
    mu_d = F.transform(_col(mu), lambda x: x.cast("double"))
    return F.transform(F.arrays_zip(w.alias("weight"), mu_d.alias("mu"), sg.alias("sigma")),
                       lambda c: F.struct(c["weight"].alias("weight"), c["mu"].alias("mu"),
                                          c["sigma"].alias("sigma")))


def mixture_mean(mixture) -> Column:
    """``sum(weight * mu)``."""
    return F.aggregate(_col(mixture), F.lit(0.0), lambda a, c: a + c["weight"] * c["mu"])


def exceedance(mixture, y) -> Column:
    """M5: probability that the outcome exceeds ``y``: ``sum w * (1 - Phi((y - mu) / sigma))``.
    NULL when any sigma is not positive."""
    y = _col(y)
    mix = _col(mixture)
    val = F.aggregate(mix, F.lit(0.0),
                      lambda a, c: a + c["weight"] * (F.lit(1.0) - normal_cdf((y - c["mu"]) / c["sigma"])))
    bad = F.exists(mix, lambda c: ~(c["sigma"] > 0))
    return F.when(~bad, val)

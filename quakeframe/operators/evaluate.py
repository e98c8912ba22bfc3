"""Ensembles and evaluation.

Ensembles are keyed (never row-position aligned; D7): predictions of any number of models
are grouped by (sample, slot). Evaluation is a two-pass R^2 per group; the first pass
produces one row per group (a size bound of #groups), joined back by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions.intensity import scale_table
from quakeframe.functions.mixture import exceedance as exceedance_col
from quakeframe.functions.portable import is_number


def ensemble(preds: DataFrame, key_cols: list[str], n_models: int | None = None,
             carry: tuple[str, ...] = ("eq_id", "p_pick", "label_time", "latitude", "longitude", "elevation")) -> DataFrame:
    """Mean ``predict`` over models per key; other columns carried, not averaged.

    ``n_models`` counts the models seen; ``answer_mismatch`` flags keys whose models disagree
    on the answer. ``check_ensemble`` turns both into errors."""
    present = [c for c in carry if c in preds.columns]
    out = preds.groupBy(*key_cols).agg(
        F.avg("predict").alias("predict"), F.first("answer").alias("answer"),
        (F.max("answer") != F.min("answer")).alias("answer_mismatch"),
        F.size(F.collect_set("model")).cast("long").alias("n_models"),  # a handful of names; no second aggregation
        *[F.first(c).alias(c) for c in present])
    if n_models is not None:
        out = out.withColumn("complete", F.col("n_models") == int(n_models))
    return out


def split_ensemble(ens: DataFrame, n_models: int) -> tuple[DataFrame, DataFrame]:
    """(complete keys, the others): evaluate the first, report the second (D7). A key is
    complete when all models predicted it and agree on the answer."""
    bad = (F.col("n_models") != int(n_models)) | F.coalesce(F.col("answer_mismatch"), F.lit(False))
    return ens.filter(~bad), ens.filter(bad)


def check_ensemble(ens: DataFrame, n_models: int) -> None:
    bad = ens.filter((F.col("n_models") != n_models) | F.col("answer_mismatch")).limit(1).count()
    if bad:
        raise ValueError("ensemble keys are unmatched between models or answers differ")


def with_exceedance(preds: DataFrame, y: str = "answer") -> DataFrame:
    """M5 per prediction row (needs the ``mixture`` column)."""
    return preds.withColumn("exceedance", exceedance_col("mixture", F.col(y)))


def evaluate(preds: DataFrame, group_cols: list[str] | None = None, y: str = "answer",
             p: str = "predict") -> DataFrame:
    """Per group ``n``, ``r2`` (1 - SSres/SStot; SStot = 0 gives 1.0 when
    SSres = 0 else 0.0; n < 2 gives NULL; not ``regr_r2``, D9), and the plot limits
    ``min(y) - 0.5``, ``max(y) + 0.5``. Rows with a non-numeric y or prediction are left out.

    One map-side-combined pass: SStot = n * var_pop(y) (Welford-style, numerically stable),
    so the predictions -- and the model behind them -- are computed once."""
    group_cols = list(group_cols or [])
    d = preds.filter(is_number(y) & is_number(p))
    agg = d.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.min(y).alias("_ymin"), F.max(y).alias("_ymax"),
        F.sum((F.col(y) - F.col(p)) ** 2).alias("ss_res"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("ss_tot"))
    r2 = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
          .when(F.col("ss_tot") == 0, F.when(F.col("ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.col("ss_res") / F.col("ss_tot")))
    return agg.select(*group_cols, "n", r2.alias("r2"), (F.col("_ymin") - 0.5).alias("lim_lo"),
                      (F.col("_ymax") + 0.5).alias("lim_hi"), "ss_res", "ss_tot")


def _on_scale(points: DataFrame, scale: DataFrame, value: str, prefix: str) -> DataFrame:
    """Range join of a value with the scale's intervals [threshold, next threshold): class, label,
    threshold and tick as ``{prefix}_...``. The last class has no upper bound, the first no lower
    one (values below the scale are class 0, D of M1); a non-numeric value has none."""
    s = scale.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("class", "label", "threshold", "tick")],
                     F.col("_next").alias("_hi"))
    x = F.col(value)
    low = (F.col(f"{prefix}_class") == 0) | (x >= F.col(f"{prefix}_threshold"))
    inside = is_number(value) & low & (F.col("_hi").isNull() | (x < F.col("_hi")))
    return points.join(F.broadcast(s), inside, "left").drop("_hi")  # ten rows


def evaluation_points(preds: DataFrame, target: str = "pga", group_cols: list[str] | None = None, y: str = "answer",
                      p: str = "predict") -> DataFrame:
    """Every point of the evaluation plot: the columns of ``preds``, where its answer and its
    prediction lie on the intensity scale of ``target`` (``answer_class``, ``_label``,
    ``_threshold`` and ``_tick``, likewise ``predict_...``), whether the classes agree
    (``same_class``), and its group's ``n``, ``r2`` and limits. Points whose answer or prediction
    is no number are kept, without class, and do not count in the group."""
    group_cols = list(group_cols or [])
    scale = scale_table(preds.sparkSession).filter(F.col("target") == target)
    scale = scale.withColumn("_next", F.lead("threshold").over(Window.orderBy("class")))
    points = _on_scale(_on_scale(preds, scale, y, "answer"), scale, p, "predict")
    points = points.withColumn("same_class", F.col("answer_class") == F.col("predict_class"))
    facts = evaluate(preds, group_cols, y, p).drop("ss_res", "ss_tot")
    if not group_cols:
        return points.join(F.broadcast(facts))  # one row
    named = facts.withColumnsRenamed({c: f"_g_{c}" for c in group_cols})
    same = F.lit(True)
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return points.join(named, same, "left").drop(*[f"_g_{c}" for c in group_cols])


def point_prediction(preds: DataFrame, agg: str = "mean", mixture_col: str = "mixture",
                     point_col: str = "predict") -> DataFrame:
    """M6: the point used for evaluation: ``mean`` = mixture mean (A6), ``point`` = the given
    prediction column; anything else is an error."""
    from quakeframe.functions.mixture import mixture_mean

    if agg == "mean":
        return preds.withColumn("point", mixture_mean(mixture_col))
    if agg == "point":
        return preds.withColumn("point", F.col(point_col))
    raise ValueError(f'Aggregation type "{agg}" unknown')

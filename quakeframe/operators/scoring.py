"""Model scoring (P1-P4, E7): the only place where Python runs on executors.

Rows handed to the scorer carry one *input set* (``waveform[S][T][C]``, ``station[S][F]``)
and a bounded list of ``targets`` (structs with at least lat, lon, elev, vs30). The scorer
protocol follows the model's input contract (P4): every target attends only to the input
stations, so a target's prediction does not depend on which other targets share the call.
That lets targets be split across rows freely, and the input set of an event is scored
once per target bucket instead of once per sample.

Scoring is ``mapInArrow``: Arrow batches in, Arrow batches out, waveforms go to NumPy
without per-value Python objects; all models of a run are evaluated in the same pass. The
input sets of a batch that have the same shape are scored by one call, up to ``CALL_BYTES`` of
waveforms at a time.
"""

from __future__ import annotations

import os
import pickle
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeframe.functions.waveform import stored_position, stored_waveform, zero_samples
from quakeframe.schema import MIXTURE_TYPE, N_COMPONENTS, PEAK_EPS
from quakeframe.session import ship


CALL_BYTES = 64 << 20  # waveforms of one call of a scorer

# Scorers that a Python worker has loaded, by their pickled definition: one load per worker.
_loaded: dict[bytes, "Scorer"] = {}


def _ready(scorer: "Scorer") -> "Scorer":
    key = pickle.dumps(scorer)
    if key not in _loaded:
        scorer.load()
        _loaded[key] = scorer
    return _loaded[key]


class Scorer(Protocol):
    name: str

    def load(self) -> None:
        """Prepare the model once per Python worker."""

    def predict(self, waveform: np.ndarray, station: np.ndarray, targets: np.ndarray, owner: np.ndarray):
        """waveform [B,S,T,C], station [B,S,F], targets [N,F'] and the input set 0..B-1 of each
        target [N] (in order) -> (weight, mu, sigma), each [N,K]. Every set has a real station;
        sets without one never reach a scorer (D26)."""


class AttenuationScorer:
    """Closed-form test scorer (FIXTURES.md B8).

    peak = largest absolute amplitude over the real input stations; dist = planar distance
    from the target to input slot 0; ``weight_k ~ exp(-alpha k)``,
    ``mu_k = log10(peak + 1e-8) - beta * dist + 0.05 (k - 2)``, ``sigma_k = exp(0.1 k - 1)``.
    """

    def __init__(self, alpha: float, beta: float, name: str):
        self.alpha, self.beta, self.name = float(alpha), float(beta), name

    def load(self) -> None:
        k = np.arange(N_COMPONENTS, dtype=np.float64)
        e = np.exp(-self.alpha * k)
        self._w = e / e.sum()
        self._shift = 0.05 * (k - 2)
        self._sigma = np.exp(0.1 * k - 1)

    def weights(self) -> list[float]:
        self.load()
        return [float(x) for x in self._w]

    def predict(self, waveform, station, targets, owner):
        real = np.any(station != 0, axis=2)
        amplitude = np.abs(waveform).max(axis=(2, 3)).astype(np.float64)
        peak = np.where(real, amplitude, -np.inf).max(axis=1)
        first = station[owner, 0]
        d = np.sqrt((targets[:, 0] - first[:, 0]) ** 2 + (targets[:, 1] - first[:, 1]) ** 2)
        mu = np.log10(peak + PEAK_EPS)[owner, None] - self.beta * d[:, None] + self._shift[None, :]
        n = targets.shape[0]
        return (np.broadcast_to(self._w, (n, N_COMPONENTS)), mu,
                np.broadcast_to(self._sigma, (n, N_COMPONENTS)))


class OnnxScorer:
    """A real model exported to ONNX with inputs ``waveform [B,S,T,C]``, ``sta [B,S,F]``,
    ``target [B,N,F]`` and outputs ``weight, sigma, mu`` of shape ``[B,N,K]``.

    A model with a free first dimension gets all sets of a call at once, the targets of each
    padded with zeros to the longest list; one exported for single sets (B = 1) gets them one
    by one. The session is created once per Python worker (tests use a small hand-built
    mixture head)."""

    def __init__(self, path: str, name: str):
        self.path, self.name = path, name
        self._sess = None

    def load(self) -> None:
        if self._sess is None:
            try:
                import onnxruntime as ort
            except ImportError as e:  # pragma: no cover
                raise RuntimeError("onnxruntime is required for OnnxScorer") from e
            path = self.path
            if not os.path.exists(path):  # on an executor: the file that came with the job
                from pyspark import SparkFiles

                path = SparkFiles.get(os.path.basename(path))
            self._sess = ort.InferenceSession(path, providers=["CPUExecutionProvider"])

    def _run(self, waveform, station, targets):
        feeds = {"waveform": waveform.astype(np.float32), "sta": station.astype(np.float32), "target": targets.astype(np.float32)}
        weight, sigma, mu = self._sess.run(["weight", "sigma", "mu"], feeds)
        return weight, mu, sigma

    def predict(self, waveform, station, targets, owner):
        sets = len(waveform)
        counts = np.bincount(owner, minlength=sets)
        ends = np.cumsum(counts)
        place = np.arange(len(owner)) - (ends - counts)[owner]
        padded = np.zeros((sets, int(counts.max()), targets.shape[1]))
        padded[owner, place] = targets
        if self._sess.get_inputs()[0].shape[0] == 1:
            one = [self._run(waveform[i:i + 1], station[i:i + 1], padded[i:i + 1, :n]) for i, n in enumerate(counts)]
            return tuple(np.concatenate([x[k][0] for x in one]) for k in range(3))
        return tuple(x[owner, place] for x in self._run(waveform, station, padded))


# --------------------------------------------------------------------------
# Building the scoring rows
# --------------------------------------------------------------------------

def input_sets(inputs: DataFrame, key_cols: list[str], n_slots: int, length: int,
               position_cols=("lat", "lon", "elev", "vs30"), wave_col: str = "waveform") -> DataFrame:
    """Collect an input set's station rows (bounded: at most ``n_slots`` per key) into
    ``waveform[S][T][3]`` and ``station[S][F]`` (double), zero-padded to ``n_slots``."""
    rows = inputs.select(*key_cols, "slot", stored_waveform(wave_col, length).alias("_w"),
                         stored_position(wave_col, position_cols).alias("_p"))
    g = rows.groupBy(*key_cols).agg(
        F.sort_array(F.collect_list(F.struct("slot", "_w", "_p"))).alias("_rows"))
    n_pad = F.lit(int(n_slots)) - F.size("_rows")
    zero_pos = F.array_repeat(F.lit(0.0), len(position_cols))
    return g.select(
        *key_cols,
        F.concat(F.transform("_rows", lambda r: r["_w"]), F.array_repeat(zero_samples(length), n_pad)).alias("waveform"),
        F.concat(F.transform("_rows", lambda r: r["_p"]), F.array_repeat(zero_pos, n_pad)).alias("station"))


def masked_input_sets(chunk0: DataFrame, key_cols: list[str], n_slots: int, length: int, sec, rate: int,
                      wave_col: str = "waveform", position_cols=("lat", "lon", "elev", "vs30"),
                      carry: tuple[str, ...] = ("n_chunks",)) -> DataFrame:
    """C3 + C6 + C7 on collected input sets: chunk-0 rows (at most ``n_slots`` per key) are
    collected in slot order, cut at ``pick of slot 0 + sec * rate`` (late stations blanked)
    as array expressions, and padded. No window, no extra shuffle. Several cut-offs (a list) are
    all cut from the one collected row, and named by ``mask_sec``."""
    from quakeframe.operators.masking import mask_members

    width = len(position_cols)
    member = F.struct("slot", "p_pick", stored_position(wave_col, position_cols).alias("pos"),
                      stored_waveform(wave_col, length).alias("waveform"))
    keep = [c for c in carry if c in chunk0.columns]
    g = chunk0.groupBy(*key_cols).agg(F.sort_array(F.collect_list(member)).alias("_in"),
                                      *[F.max(c).alias(c) for c in keep])
    if isinstance(sec, (list, tuple)):
        g, keep = g.withColumn("mask_sec", F.explode(F.array(*[F.lit(int(x)) for x in sec]))), [*keep, "mask_sec"]
        cutoff = F.when(F.col("mask_sec") != 0, F.col("_in")[0]["p_pick"] + F.col("mask_sec") * int(rate)).cast("int")
    elif sec:
        cutoff = (F.col("_in")[0]["p_pick"] + F.lit(int(sec)) * int(rate)).cast("int")
    else:
        cutoff = F.lit(None).cast("int")
    g = g.withColumn("_cutoff", cutoff).withColumn("_in", mask_members("_in", F.col("_cutoff"), length, width))
    n_pad = F.greatest(F.lit(int(n_slots)) - F.size("_in"), F.lit(0))
    zero_pos = F.array_repeat(F.lit(0.0), width)
    return g.select(
        *key_cols, *keep,
        F.concat(F.transform("_in", lambda e: e["waveform"]), F.array_repeat(zero_samples(length), n_pad)).alias("waveform"),
        F.concat(F.transform("_in", lambda e: e["pos"]), F.array_repeat(zero_pos, n_pad)).alias("station"))


def target_groups(targets: DataFrame, key_cols: list[str], fields: list[str],
                  bucket_col: str | None = "chunk_no", per_row: int = 1024) -> DataFrame:
    """Group target rows under their input-set key in buckets of at most ``per_row`` chunks
    (``_tb = bucket_col // per_row``), so no row grows with the size of an event."""
    bucket = (F.col(bucket_col) / per_row).cast("int") if bucket_col else F.lit(0)
    return (targets.withColumn("_tb", bucket)
            .groupBy(*key_cols, "_tb")
            .agg(F.collect_list(F.struct(*[F.col(f) for f in fields])).alias("targets")))


def scoring_rows(sets: DataFrame, groups: DataFrame, key_cols: list[str], n_chunks_col: str = "n_chunks",
                 per_row: int = 1024) -> DataFrame:
    """Pair every target bucket with its input set. The set row is exploded over the
    buckets its event has (``ceil(n_chunks / per_row)``; one copy for a normal event) and the
    join key includes the bucket, so the buckets of a hot event land in different tasks."""
    s = sets.withColumn("_tb", F.explode(F.sequence(F.lit(0), ((F.col(n_chunks_col) - 1) / per_row).cast("int"))))
    return s.drop(n_chunks_col).join(groups, [*key_cols, "_tb"]).drop("_tb")


def _shapes(col, depth: int) -> np.ndarray:
    """Per row of a nested list column the length at each of ``depth`` levels; -1 in a row that
    is NULL or not rectangular."""
    import pyarrow as pa

    n = len(col)
    out = np.full((n, depth), -1, np.int64)
    row = np.arange(n)  # the row of each list of the level
    ok = np.ones(n, bool)
    for level in range(depth):
        lens = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
        np.minimum.at(low, row, lens)
        np.maximum.at(high, row, lens)
        ok &= (low == high) & (high > 0)
        out[:, level] = high
        row = np.repeat(row, np.maximum(lens, 0))
        col = col.flatten()
        if level + 1 < depth and not isinstance(col, (pa.ListArray, pa.LargeListArray)):
            raise TypeError("not nested deep enough")
    out[~ok] = -1
    return out


def _values(col, depth: int) -> np.ndarray:
    for _ in range(depth):
        col = col.flatten()
    return col.to_numpy(zero_copy_only=False)  # in the stored precision


def _calls(wave_c, sta_c):
    """(rows, waveform [B,S,T,C], station [B,S,F]) of the rows that share a shape, in pieces of
    at most CALL_BYTES; rows of no shape come last with None."""
    import pyarrow as pa

    both = np.concatenate([_shapes(wave_c, 3), _shapes(sta_c, 2)], axis=1)
    both[(both < 0).any(axis=1) | (both[:, 0] != both[:, 3])] = -1
    kinds, which = np.unique(both, axis=0, return_inverse=True)
    which = which.reshape(-1)
    for k, shape in enumerate(kinds):
        rows = np.flatnonzero(which == k)
        if shape[0] < 0:
            yield rows, None, None
            continue
        step = max(1, CALL_BYTES // int(shape[:3].prod() * 4))
        for i in range(0, len(rows), step):
            some = rows[i:i + step]
            w, st = (c if len(some) == len(c) else c.take(pa.array(some)) for c in (wave_c, sta_c))
            yield some, _values(w, 3).reshape(-1, *shape[:3]), _values(st, 2).reshape(-1, *shape[3:])


def score(rows: DataFrame, scorers: list, key_cols: list[str], target_pos=("lat", "lon", "elev", "vs30"),
          mixture: bool = True) -> DataFrame:
    """One output row per (input set, target, model) with the mixture and its mean.

    ``rows``: key columns, ``waveform``, ``station``, ``targets`` (array of structs). An input
    set that cannot be scored keeps its rows, with NULL mixture and prediction and a
    ``reason``: ``ragged`` (NULL or not rectangular) or ``no_station`` (none left to use)."""
    sc = rows.sparkSession.sparkContext
    ship(rows.sparkSession)
    for path in {s.path for s in scorers if getattr(s, "path", None)}:
        if os.path.exists(path):  # a model file of the driver's machine travels with the job
            sc.addFile(path)
    target_type = rows.schema["targets"].dataType.elementType
    key_fields = [rows.schema[k] for k in key_cols]
    out_schema = T.StructType(key_fields + [
        T.StructField("target", target_type, True),
        T.StructField("model", T.StringType(), False),
        T.StructField("mixture", MIXTURE_TYPE, True),
        T.StructField("predict", T.DoubleType(), True),
        T.StructField("reason", T.StringType(), True)])
    run = make_runner(list(scorers), key_cols, list(target_pos), out_schema)
    out = rows.mapInArrow(run, out_schema)
    return out if mixture else out.drop("mixture")


def make_runner(scorer_list: list, key_cols: list[str], pos_names: list[str], out_schema: T.StructType):
    """The Arrow batch function of ``score`` (module level so it can be tested directly)."""

    def run(batches):
        import pyarrow as pa

        out_arrow = _arrow_schema(out_schema)
        ready = [_ready(s) for s in scorer_list]
        mix_type = pa.list_(pa.struct([("weight", pa.float64()), ("mu", pa.float64()), ("sigma", pa.float64())]))
        for batch in batches:
            tg_c = batch.column("targets")
            tg_flat = tg_c.flatten()
            # Offsets rebuilt from lengths: a sliced batch's raw offsets do not start at 0,
            # while flatten() does (and skips NULL lists).
            lens = tg_c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offs = np.concatenate([[0], np.cumsum(lens)])
            pos_all = np.stack([tg_flat.field(p).to_numpy(zero_copy_only=False).astype(np.float64)
                                for p in pos_names], axis=1) if len(tg_flat) else np.zeros((0, len(pos_names)))

            def out(rows, model, mix, mean, reason):
                """The rows' targets with what a model says of them."""
                n = lens[rows]
                at = np.repeat(offs[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
                take = pa.array(np.repeat(rows, n))
                cols = [batch.column(kc).take(take) for kc in key_cols]
                cols += [tg_flat.take(pa.array(at)), pa.array([model] * len(at), pa.string()),
                         mix if mix is not None else pa.nulls(len(at), mix_type),
                         mean if mean is not None else pa.nulls(len(at), pa.float64()),
                         pa.array([reason] * len(at), pa.string())]
                return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out_arrow)], schema=out_arrow)

            for rows, wave, sta in _calls(batch.column("waveform"), batch.column("station")):
                if wave is not None:
                    asked, real = lens[rows] > 0, (sta != 0).any(axis=(1, 2))
                    if (asked & ~real).any():
                        yield from (out(rows[asked & ~real], s.name, None, None, "no_station") for s in ready)
                    some = asked & real
                    if not some.any():
                        continue
                    rows, wave, sta = rows[some], wave[some] if not some.all() else wave, sta[some]
                    n = lens[rows]
                    owner = np.repeat(np.arange(len(rows)), n)
                    tpos = np.concatenate([pos_all[offs[r]:offs[r + 1]] for r in rows])
                    for s in ready:
                        w, mu, sg = (np.ascontiguousarray(x, dtype=np.float64).reshape(len(owner), -1) for x in s.predict(wave, sta, tpos, owner))
                        comp = pa.StructArray.from_arrays([pa.array(x.ravel()) for x in (w, mu, sg)], ["weight", "mu", "sigma"])
                        ends = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
                        yield out(rows, s.name, pa.ListArray.from_arrays(ends, comp, type=mix_type), pa.array((w * mu).sum(axis=1)), None)
                elif lens[rows].any():
                    yield from (out(rows[lens[rows] > 0], s.name, None, None, "ragged") for s in ready)

    return run


def _arrow_schema(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def flatten_predictions(scored: DataFrame, key_cols: list[str], target_fields: list[str]) -> DataFrame:
    """One row per (key, target, model) with the target's fields as columns."""
    return scored.select(*key_cols, "model", *[F.col("target")[f].alias(f) for f in target_fields],
                         "mixture", "predict")


def pad_predictions(preds: DataFrame, group: list[str], n_slots: int, slot_col: str = "slot",
                    size_col: str | None = "chunk_size") -> DataFrame:
    """E7 padding: like the reference's fixed 25-target output, add rows for missing slots
    with NULL picks/times/ids and zero answers and positions, flagged ``is_real = false``
    (F8 filters on the flag, not on ``answer != 0``; D4). With ``size_col`` (targets in the
    sample) this is a single pass over the predictions: the model is never re-run."""
    from quakeframe.operators.masking import pad_slots

    fill = {c: 0.0 for c in ("answer", "latitude", "longitude", "elevation") if c in preds.columns}
    p = pad_slots(preds, group, n_slots, slot_col=slot_col, fill=fill,
                  size_col=size_col if size_col in preds.columns else None)
    return p.withColumn("is_real", ~F.col("is_padding")).drop("is_padding")

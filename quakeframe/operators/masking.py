"""Cut-off masking (C6/C7), random horizons (E5), station blinding (E6) and slot padding
(C3/C4).

All of these act on input rows, of which an event or a sample has at most
``max_station_num``; every window here is therefore over a bounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions.portable import hash_uniform
from quakeframe.functions.waveform import blank_if, fit_waveform  # noqa: F401
from quakeframe.schema import MAX_STATIONS

POSITION_COLS = ("lat", "lon", "elev", "vs30")


def is_padding(position) -> Column:
    """a station slot is padding when every coordinate is zero."""
    return F.forall(F.col(position) if isinstance(position, str) else position, lambda x: x == 0)


def with_pick0(rows: DataFrame, group: list[str], slot_col: str = "slot") -> DataFrame:
    """Reference pick = pick of slot 0 of the group's input side (in the chosen order)."""
    w = Window.partitionBy(*group).orderBy(slot_col)
    return rows.withColumn("pick0", F.first("p_pick").over(w))


def apply_cutoff(rows: DataFrame, sec, rate: int, length: int, wave_col: str = "waveform",
                 position_cols=POSITION_COLS) -> DataFrame:
    """C1 + C2 + C6 + C7 on input rows carrying ``p_pick``, ``pick0`` and a waveform. A NULL
    waveform (none stored) blanks the station like a late pick.

    ``cutoff = pick0 + sec * rate`` (in samples). Every trace is cropped/padded to
    ``length`` and zeroed from ``cutoff`` on; a station whose pick is strictly later than the
    cut-off is blanked (waveform and position set to zero). ``sec`` None or 0 means no mask.
    """
    if "has_waveform" in rows.columns:  # said beside the waveform: ``blanked`` alone reads no samples
        none = ~F.col("has_waveform")
    else:
        none = F.col(wave_col).isNull() if wave_col in rows.columns else F.lit(False)
    if sec is None or (not isinstance(sec, Column) and sec == 0):
        cutoff, late = F.lit(None).cast("int"), none
    else:
        sec_c = sec if isinstance(sec, Column) else F.lit(int(sec))
        cutoff = (F.col("pick0") + sec_c * int(rate)).cast("int")
        late = F.coalesce(F.col("p_pick") > F.col("cutoff"), F.lit(False)) | none  # NULL pick: not blanked
    out = rows.withColumn("cutoff", cutoff).withColumn("blanked", late)
    if wave_col in rows.columns:
        fit = fit_waveform(wave_col, length) if sec is None or (not isinstance(sec, Column) and sec == 0) \
            else fit_waveform(wave_col, length, F.col("cutoff"))
        out = out.withColumn(wave_col, blank_if(fit, F.col("blanked"), length))
    for c in position_cols:
        if c in rows.columns:
            out = out.withColumn(c, F.when(F.col("blanked"), F.lit(0.0)).otherwise(F.col(c)))
    return out


def random_cutoff_sec(key_cols: list[str], mask_sec: int, max_sec: int = 10, epoch: int = 0,
                      seed: str = "0") -> Column:
    """E5: an integer horizon in ``[mask_sec, max_sec)`` drawn per sample and epoch.

    A hash of the sample key, not a generator state: identical after task retries."""
    u = hash_uniform(*key_cols, salt=f"horizon|{epoch}|{seed}")
    return (F.lit(int(mask_sec)) + F.floor(u * (int(max_sec) - int(mask_sec)))).cast("int")


def blinded_slots(stations, key: list, n_slots: int, epoch: int = 0, seed: str = "0") -> Column:
    """E6, the draw: of the n real stations of a sample the slots of a random k in [0, n-1],
    without replacement (n = 0 gives k = 0; D28). ``stations`` is an array of at most ``n_slots``
    structs (slot, real); k comes from a hash of the sample's ``key``, and the k stations are
    those with the smallest hash of key and slot (ties: smaller slot). Narrow (no waveform is
    touched), and written out per slot, so that it runs in generated code; the count is a lambda,
    which keeps the step out of the one method of its stage (see ``hidden_positions``)."""
    stations = F.col(stations) if isinstance(stations, str) else stations
    at = [F.get(stations, i) for i in range(int(n_slots))]
    real = [F.coalesce(e["real"], F.lit(False)) for e in at]
    n = F.size(F.filter(F.array(*real), lambda r: r))
    k = F.floor(hash_uniform(*key, salt=f"blind-k|{epoch}|{seed}") * n).cast("int")
    last = F.lit(2.0)  # behind every draw
    drawn = F.sort_array(F.array(*[F.struct(
        F.when(r, hash_uniform(*key, e["slot"], salt=f"blind-pick|{epoch}|{seed}")).otherwise(last).alias("u"),
        F.coalesce(e["slot"], F.lit(-1)).alias("slot")) for e, r in zip(at, real)]))
    return F.slice(drawn, 1, k).getField("slot")


def blind_stations(rows: DataFrame, sample_key: list[str], slot_col: str = "slot", epoch: int = 0,
                   seed: str = "0", wave_col: str = "waveform", length: int | None = None,
                   position_cols=POSITION_COLS, n_slots: int = MAX_STATIONS) -> DataFrame:
    """E6 on member rows: blank the ``blinded_slots`` of every sample among its stations with a
    non-zero position. The window is per sample (at most ``n_slots`` rows; more are an error) and
    gathers slots only; the draw is made once per sample."""
    present = [c for c in position_cols if c in rows.columns]
    nonzero = F.lit(False)
    for c in present:
        nonzero = nonzero | (F.coalesce(F.col(c), F.lit(0.0)) != 0)
    w = Window.partitionBy(*sample_key)
    drawn = F.when(F.size("_st") > int(n_slots), F.raise_error(F.lit(f"a sample has more than {int(n_slots)} stations")).cast("array<int>")) \
        .otherwise(blinded_slots("_st", [F.col(c) for c in sample_key], n_slots, epoch, seed))
    out = (rows.withColumn("_real", nonzero)
           .withColumn("_st", F.collect_list(F.struct(F.col(slot_col).alias("slot"), F.col("_real").alias("real"))).over(w))
           .withColumn("_lead", F.min(slot_col).over(w))
           .withColumn("_gone", F.first(F.when(F.col(slot_col) == F.col("_lead"), drawn), ignorenulls=True).over(w))
           .withColumn("blinded", F.col("_real") & F.array_contains("_gone", F.col(slot_col))))
    if wave_col in rows.columns and length is not None:
        out = out.withColumn(wave_col, blank_if(wave_col, F.col("blinded"), length))
    for c in present:
        out = out.withColumn(c, F.when(F.col("blinded"), F.lit(0.0)).otherwise(F.col(c)))
    return out.drop("_real", "_st", "_lead", "_gone")


def pad_slots(rows: DataFrame, group: list[str], n_slots: int, slot_col: str = "slot",
              fill: dict | None = None, size_col: str | None = None) -> DataFrame:
    """Add padding rows for slots ``n_real .. n_slots-1`` of every group (none when
    the group is already full or longer: no truncation). Padding rows carry
    ``is_padding = true`` and the ``fill`` values (zeros by default); other columns are
    NULL except the group keys.

    With ``size_col`` (the group's real size, carried on every row), the padding rows are
    generated from the group's slot-0 row by one ``explode``: a single pass over ``rows``.
    Without it, group sizes are counted first and the input is read twice."""
    fill = fill or {}
    if size_col:
        pad_slots_ = F.when((F.col(slot_col) == 0) & (F.col(size_col) < n_slots),
                            F.sequence(F.col(size_col).cast("int"), F.lit(n_slots - 1))) \
            .otherwise(F.array().cast("array<int>"))
        marks = F.concat(F.array(F.lit(-1)), pad_slots_)
        x = rows.withColumn("_pad", F.explode(marks))
        is_pad = F.col("_pad") >= 0
        keep = set(group) | {slot_col, "_pad"}
        out = x
        for c in rows.columns:
            if c in keep:
                continue
            val = fill.get(c)
            val = (val if isinstance(val, Column) else F.lit(val)) if c in fill else F.lit(None)
            out = out.withColumn(c, F.when(is_pad, val.cast(rows.schema[c].dataType)).otherwise(F.col(c)))
        return (out.withColumn(slot_col, F.when(is_pad, F.col("_pad")).otherwise(F.col(slot_col)))
                .withColumn("is_padding", is_pad).drop("_pad"))
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n_real"))
    pads = (counts.filter(F.col("_n_real") < n_slots)
            .select(*group, F.explode(F.sequence(F.col("_n_real").cast("int"), F.lit(n_slots - 1))).alias(slot_col)))
    for c, v in fill.items():
        pads = pads.withColumn(c, v if isinstance(v, Column) else F.lit(v))
    real = rows.withColumn("is_padding", F.lit(False))
    pads = pads.withColumn("is_padding", F.lit(True))
    return real.unionByName(pads, allowMissingColumns=True)


# --------------------------------------------------------------------------
# The same masks on a collected member array (one row per sample, members =
# struct(slot, p_pick, waveform, pos, ...)); no shuffle, at most max_station_num members.
# --------------------------------------------------------------------------

def mask_members(members, cutoff, length: int, pos_width: int = 4) -> Column:
    """C6 + C7 per member: blank members whose pick is later than ``cutoff``; zero every
    member's waveform from ``cutoff`` on (``cutoff`` NULL: crop/pad only)."""
    from quakeframe.functions.waveform import zero_samples

    arr = F.col(members) if isinstance(members, str) else members
    zero_pos = F.array_repeat(F.lit(0.0), pos_width)

    def one(e):
        late = F.coalesce(e["p_pick"] > cutoff, F.lit(False))
        w = F.when(cutoff.isNull(), fit_waveform(e["waveform"], length)) \
            .otherwise(fit_waveform(e["waveform"], length, cutoff))
        return (e.withField("blanked", late)
                .withField("waveform", F.when(late, zero_samples(length)).otherwise(w))
                .withField("pos", F.when(late, zero_pos).otherwise(e["pos"])))

    return F.transform(arr, one)


def with_slot_mask(samples: DataFrame, stations: str, cutoff: Column, key: list | None, n_slots: int,
                   epoch: int = 0, seed: str = "0", mask_col: str = "hidden") -> DataFrame:
    """C7 + E6 of each sample as a slot mask: ``mask_col``, one boolean per slot, whether its member
    is blanked, because its pick is later than ``cutoff`` or it has been blinded (with a ``key``;
    drawn among the real stations that are not late). ``stations``: array of structs (slot, p_pick,
    real) in slot order. Each step is a column of its own, computed once and in generated code."""
    at = [F.get(F.col(stations), i) for i in range(int(n_slots))]
    late = [F.coalesce(e["p_pick"] > cutoff, F.lit(False)) for e in at]
    if key is None:
        return samples.withColumn(mask_col, F.array(*late))
    samples = samples.withColumn("_late", F.array(*late))
    left = F.array(*[F.struct(e["slot"].alias("slot"), (e["real"] & ~F.get("_late", F.lit(i))).alias("real")) for i, e in enumerate(at)])
    samples = samples.withColumn("_left", left).withColumn("_gone", blinded_slots("_left", key, n_slots, epoch, seed))
    hidden = F.array(*[F.get("_late", F.lit(i)) | F.coalesce(F.array_contains("_gone", e["slot"]), F.lit(False)) for i, e in enumerate(at)])
    return samples.withColumn(mask_col, hidden).drop("_late", "_left", "_gone")


def hidden_waveforms(waves: str, hidden: str, cutoff: Column, n_slots: int) -> Column:
    """C6 + C7 + E6 + C3 in one pass over the waveforms of a sample: zero from ``cutoff`` on (NULL:
    nothing), all zero where the slot mask hides the member, and zero up to ``n_slots``. The
    last element of ``waves`` is a zero waveform of the same length: taking it, or slices
    of it, copies bytes instead of building arrays."""
    zero = F.element_at(waves, -1)
    n = F.size(waves) - 1
    keep = F.greatest(cutoff, F.lit(0))
    whole = cutoff.isNull() | (cutoff >= F.size(zero))

    def one(i):
        w = F.get(F.col(waves), i)
        cut = F.when(whole, w).otherwise(F.concat(F.slice(w, 1, keep), F.slice(zero, 1, F.size(zero) - keep)))
        return F.when((F.lit(i) >= n) | F.get(F.col(hidden), i), zero).otherwise(cut)

    return F.array(*[one(i) for i in range(int(n_slots))])


def hidden_positions(positions: str, hidden: str, n_slots: int, pos_width: int = 4) -> Column:
    """The positions beside ``hidden_waveforms``: zero where hidden, and zero up to ``n_slots``.

    A lambda over the slots: Spark then compiles the projection that holds both by itself, in small
    methods, instead of into the one method of its stage with all steps before, which is too
    large to run fast."""
    zero = F.array(*[F.lit(0.0)] * pos_width)
    slots = F.sequence(F.lit(0), F.lit(int(n_slots) - 1))
    return F.transform(slots, lambda i: F.when((i >= F.size(positions)) | F.get(F.col(hidden), i), zero).otherwise(F.get(F.col(positions), i)))

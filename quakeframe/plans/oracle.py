"""DuckDB SQL oracles for the registered queries (same names, same output columns).

The fixture views come from ``sources.fixtures.SQL_VIEWS``; fixed values are written out here
anew, not taken from the engine, so that a wrong constant there does not pass.
"""

from __future__ import annotations

import math

from quakeframe.plans import queries as q
from quakeframe.sources import fixtures as fx
from quakeframe.sources.fixtures import with_views

# Fixed values of the intensity scales, the balancing cut-offs, the error function, the position
# embedding and the test scorers.
INTENSITY10_LABELS = ["0", "1", "2", "3", "4", "5-", "5+", "6-", "6+", "7"]
LOG_PGA10 = [math.log10(x) for x in (1e-5, 0.008, 0.025, 0.080, 0.250, 0.80, 1.4, 2.5, 4.4, 8.0)]
LOG_PGV10 = [math.log10(x) for x in (1e-5, 0.002, 0.007, 0.019, 0.057, 0.15, 0.3, 0.5, 0.8, 1.4)]
LOG_PGA8 = [math.log10(x) for x in (0.008, 0.025, 0.08, 0.25, 0.8, 2.5, 8.0)]
LOG_PGV8 = [math.log10(x) for x in (0.002, 0.007, 0.019, 0.057, 0.15, 0.5, 1.4)]
LOG10_DOWNSAMPLE_BELOW, LOG10_OVERSAMPLE_ABOVE = math.log10(0.019), math.log10(0.057)
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
EMB_DIM, EMB_WAVELENGTHS = 150, ((5.0, 30.0), (110.0, 123.0), (0.01, 5000.0))

TY = fx.TEST_YEAR
M = fx.MAX_STATIONS_FX


def lit(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def u_sql(*keys: str, salt: str) -> str:
    parts = ", ".join([f"CAST({k} AS VARCHAR)" for k in keys] + [f"'{salt}'"])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def num(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isnan({x}))"


def bisect_sql(x: str, bounds) -> str:
    whens = " ".join(f"WHEN {x} >= {lit(b)} THEN {i}" for i, b in reversed(list(enumerate(bounds))) if i > 0)
    return f"(CASE WHEN NOT {num(x)} THEN NULL {whens} ELSE 0 END)"


def intensity10_sql(pga: str, pgv: str | None = None) -> str:
    c = bisect_sql(pga, LOG_PGA10)
    if pgv is None:
        return c
    cv = bisect_sql(pgv, LOG_PGV10)
    return (f"(CASE WHEN {num(pga)} AND {pga} > {lit(LOG_PGA10[5])} AND {num(pgv)} "
            f"THEN greatest({c}, {cv}) ELSE {c} END)")


def intensity8_sql(x: str, bounds=LOG_PGA8) -> str:
    whens = " ".join(f"WHEN {x} >= {lit(b)} THEN {i + 1}" for i, b in reversed(list(enumerate(bounds))))
    return f"(CASE WHEN NOT {num(x)} THEN NULL {whens} ELSE 0 END)"


def label_sql(c: str) -> str:
    arr = "[" + ", ".join(f"'{s}'" for s in INTENSITY10_LABELS) + "]"
    return f"{arr}[{c} + 1]"


def events_sql(mode="all", mag=0.0) -> str:
    cond = f"{num('magnitude')} AND magnitude >= {lit(mag)}"
    if mode == "train":
        cond += f" AND year <> {TY}"
    elif mode == "test":
        cond += f" AND year = {TY}"
    return f"SELECT * FROM fx_catalog WHERE {cond}"


def traces_sql(mode="all", label="pga", view="fx_traces") -> str:
    return (f"SELECT t.*, e.magnitude FROM {view} t JOIN ({events_sql(mode)}) e ON t.eq_id = e.eq_id "
            f"WHERE {num('t.' + label)}")


def ranked_sql(src: str, m: int) -> str:
    return f"""
        SELECT *, CAST(pos // {m} AS INTEGER) AS chunk_no, CAST(pos % {m} AS INTEGER) AS slot,
               CAST((n_traces + {m - 1}) // {m} AS INTEGER) AS n_chunks
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY eq_id ORDER BY p_pick NULLS LAST, trace_idx) - 1 AS INTEGER) AS pos,
                     CAST(count(*) OVER (PARTITION BY eq_id) AS INTEGER) AS n_traces
              FROM ({src}))"""


def samples_sql(ranked: str, bias=False) -> str:
    """Long-form samples from a ranked CTE name (no event copies)."""
    sid = "concat_ws('/', eq_id, 0, chunk_no, CAST(is_bias AS INTEGER))"
    roles = "[{'side': 'input', 'is_bias': false}]"
    if bias:
        roles = ("CASE WHEN c0.n_chunks > 1 THEN [{'side': 'input', 'is_bias': false}, "
                 "{'side': 'input', 'is_bias': true}, {'side': 'target', 'is_bias': true}] "
                 "ELSE [{'side': 'input', 'is_bias': false}] END")
    return f"""
        SELECT *, 0 AS event_copy, {sid} AS sample_id FROM (
          SELECT * EXCLUDE (chunk_no, slot), chunk_no, slot, false AS is_bias, 'target' AS side FROM {ranked}
          UNION ALL
          SELECT * EXCLUDE (_role, chunk_no, slot, _sc), _sc AS chunk_no, slot,
                 _role.is_bias AS is_bias, _role.side AS side
          FROM (SELECT c0.*, s._sc, unnest({roles}) AS _role
                FROM {ranked} c0 JOIN (SELECT eq_id, chunk_no AS _sc FROM {ranked} WHERE slot = 0) s
                  ON c0.eq_id = s.eq_id
                WHERE c0.chunk_no = 0))"""


def weights_sql(src: str) -> str:
    cls = intensity8_sql("pga")
    return f"""
        SELECT w.*, 1.0 / h.n AS weight FROM (SELECT *, {cls} AS class FROM ({src})) w
        JOIN (SELECT {cls} AS class, count(*) AS n FROM ({src}) GROUP BY 1) h ON w.class IS NOT DISTINCT FROM h.class"""


ORACLE: dict[str, str] = {}

ORACLE["events_by_magnitude"] = with_views(
    f"SELECT eq_id, year, magnitude FROM ({events_sql(mag=q.MAG_T)})", "fx_catalog")

ORACLE["events_small_sampled"] = with_views(f"""
    SELECT eq_id, year, magnitude, false AS is_small FROM ({events_sql(mag=q.MAG_T)})
    UNION ALL
    SELECT eq_id, year, magnitude, true AS is_small FROM fx_catalog
    WHERE {num('magnitude')} AND magnitude < {lit(q.MAG_T)} AND year <> {TY}
      AND {u_sql('eq_id', salt='small-event|0')} < 0.25""", "fx_catalog")

ORACLE["events_small_sampled_exact"] = with_views(f"""
    SELECT eq_id, year, magnitude, false AS is_small FROM ({events_sql(mag=q.MAG_T)})
    UNION ALL
    SELECT eq_id, year, magnitude, true AS is_small FROM (
      SELECT *, row_number() OVER (ORDER BY u, eq_id) - 1 AS r, count(*) OVER () AS n FROM (
        SELECT *, {u_sql('eq_id', salt='small-event|0')} AS u FROM fx_catalog
        WHERE {num('magnitude')} AND magnitude < {lit(q.MAG_T)} AND year <> {TY}))
    WHERE r < round_even(n * 0.25, 0)""", "fx_catalog")

ORACLE["events_year_split"] = with_views(f"""
    SELECT 'train' AS mode, eq_id, year FROM ({events_sql('train', q.MAG_T)})
    UNION ALL SELECT 'test' AS mode, eq_id, year FROM ({events_sql('test', q.MAG_T)})""", "fx_catalog")

ORACLE["events_first_half"] = with_views(
    "SELECT eq_id, year, magnitude FROM fx_catalog ORDER BY eq_id LIMIT (SELECT count(*) // 2 FROM fx_catalog)", "fx_catalog")

ORACLE["events_first_n"] = with_views(
    f"SELECT eq_id, year, magnitude FROM ({events_sql('train', q.MAG_T)}) ORDER BY eq_id LIMIT {q.FIRST_N}",
    "fx_catalog")

ORACLE["replay_year_ids"] = with_views(f"SELECT eq_id FROM fx_catalog WHERE year = {TY}", "fx_catalog")

ORACLE["matched_and_skipped"] = with_views(f"""
    SELECT e.eq_id, e.eq_id IN (SELECT eq_id FROM fx_traces) AS contained
    FROM ({events_sql(mag=q.MAG_T)}) e""", "fx_catalog", "fx_traces")

ORACLE["event_groups_exploded"] = """
    SELECT eq_id, trace_idx, round(CAST(v AS DOUBLE), 6) AS pga FROM (
      SELECT vec_id AS eq_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS trace_idx, unnest(embedding) AS v
      FROM embeddings)"""

ORACLE["event_groups_parallel"] = """
    WITH g AS (SELECT vec_id AS eq_id, 20 + vec_id % 30 AS n, vec_id % 3 AS cut, vec_id % 7 = 0 AS no_pgv,
                      list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id % 11 <> 0),
    t AS (SELECT *, CAST(unnest(range(0, n)) AS INTEGER) AS trace_idx FROM g)
    SELECT 'pga' AS label_key, eq_id, trace_idx, CASE WHEN trace_idx < n - cut THEN CAST(floor(abs(e[trace_idx + 1]) * 1000) AS INTEGER) END AS p_pick,
           round(e[trace_idx + 1], 6) AS label, CAST(floor(abs(e[trace_idx + 3]) * 1000) AS INTEGER) AS label_time FROM t
    UNION ALL
    SELECT 'pgv', eq_id, trace_idx, CASE WHEN trace_idx < n - cut THEN CAST(floor(abs(e[trace_idx + 1]) * 1000) AS INTEGER) END,
           CASE WHEN NOT no_pgv THEN round(e[trace_idx + 5], 6) END,
           CASE WHEN NOT no_pgv THEN CAST(floor(abs(e[trace_idx + 2]) * 1000) AS INTEGER) END FROM t"""

ORACLE["valid_traces"] = with_views(
    f"SELECT eq_id, count(*) AS n_valid FROM ({traces_sql()}) GROUP BY eq_id", "fx_catalog", "fx_traces")

ORACLE["downsample_small"] = with_views(f"""
    SELECT eq_id, trace_idx, round(pgv, 6) AS label FROM ({traces_sql(label='pgv')})
    WHERE NOT (pgv < {lit(LOG10_DOWNSAMPLE_BELOW)} AND {u_sql('eq_id', 'trace_idx', salt='downsample|0')} < 0.5)""",
    "fx_catalog", "fx_traces")

ORACLE["oversample_events"] = with_views(f"""
    SELECT eq_id, CAST(unnest(range(0, n + 1)) AS INTEGER) AS event_copy FROM (
      SELECT eq_id, CASE WHEN magnitude >= {lit(q.OVERSAMPLE_MAG)}
                         THEN greatest(CAST(trunc(pow({lit(q.OVERSAMPLE)}, magnitude - 1) - 1) AS INTEGER), 0)
                         ELSE 0 END AS n
      FROM ({events_sql()}) WHERE eq_id IN (SELECT eq_id FROM fx_traces WHERE {num('pga')}))""",
    "fx_catalog", "fx_traces")

ORACLE["oversample_traces"] = with_views(f"""
    SELECT eq_id, trace_idx, CAST(unnest(range(0, n + 1)) AS INTEGER) AS trace_copy FROM (
      SELECT eq_id, trace_idx,
             CASE WHEN pga > {lit(LOG10_OVERSAMPLE_ABOVE)}
                  THEN CAST(round_even(pow(4.5, pow(1.5, pga)) + 1, 0) AS INTEGER) ELSE 0 END AS n
      FROM ({traces_sql()}))""", "fx_catalog", "fx_traces")

ORACLE["pick_decimation"] = with_views(
    f"SELECT eq_id, trace_idx, CAST(floor(p_pick / {q.DECIMATE}) AS INTEGER) AS p_pick FROM fx_traces",
    "fx_traces")

ORACLE["intensity10_pga_pgv"] = with_views(f"""
    SELECT eq_id, trace_idx, c AS intensity, {label_sql('c')} AS intensity_label FROM (
      SELECT eq_id, trace_idx, {intensity10_sql('pga', 'pgv')} AS c FROM ({traces_sql()}))""",
    "fx_catalog", "fx_traces")

ORACLE["intensity8_classes"] = with_views(
    f"SELECT {intensity8_sql('pga')} AS class, count(*) AS n FROM ({traces_sql()}) GROUP BY 1",
    "fx_catalog", "fx_traces")

ORACLE["label_weights"] = with_views(
    f"SELECT eq_id, trace_idx, class, weight FROM ({weights_sql(f'SELECT t.* FROM fx_traces t JOIN ({events_sql()}) e ON t.eq_id = e.eq_id')})", "fx_catalog", "fx_traces")

_scale_rows = ", ".join(f"('{t}', {i}, '{INTENSITY10_LABELS[i]}', {lit(b)})"
                        for t, bounds in (("pga", LOG_PGA10), ("pgv", LOG_PGV10)) for i, b in enumerate(bounds))
ORACLE["intensity_ticks"] = with_views(f"""
    , scale AS (SELECT * FROM (VALUES {_scale_rows}) v(target, class, label, threshold)),
    mids AS (SELECT *, (threshold + lead(threshold) OVER (PARTITION BY target ORDER BY class)) / 2 AS _mid FROM scale),
    ticks AS (SELECT *, CASE WHEN _mid IS NOT NULL THEN _mid
                   ELSE lag(_mid, 1) OVER (PARTITION BY target ORDER BY class) * 2
                        - lag(_mid, 2) OVER (PARTITION BY target ORDER BY class) END AS tick FROM mids),
    tr AS ({traces_sql()}),
    counts AS (SELECT 'pga' AS target, {intensity10_sql('pga')} AS class, count(*) AS n FROM tr GROUP BY 2
               UNION ALL SELECT 'pgv' AS target, {intensity10_sql('pgv')} AS class, count(*) AS n FROM tr GROUP BY 2)
    SELECT s.target, CAST(s.class AS INTEGER) AS class, s.label, round(s.threshold, 6) AS threshold,
           round(s.tick, 6) AS tick, (s.class >= 3 AND s.class <= 8) AS display_line,
           coalesce(c.n, 0) AS n_traces
    FROM ticks s LEFT JOIN counts c ON s.target = c.target AND s.class = c.class""",
    "fx_catalog", "fx_traces")

ORACLE["rank_by_pick"] = with_views(
    f"SELECT eq_id, trace_idx, pos, chunk_no, slot, n_chunks FROM ({ranked_sql(traces_sql(), M)})",
    "fx_catalog", "fx_traces")

_RANKED = f"rk AS ({ranked_sql(traces_sql(), M)})"
_TEST_RANKED = f"rk AS ({ranked_sql(traces_sql('test'), M)})"
ORACLE["build_samples"] = with_views(f"""
    , {_RANKED}
    SELECT sample_id, eq_id, event_copy, chunk_no, is_bias, side, slot, trace_idx FROM ({samples_sql('rk')})""",
    "fx_catalog", "fx_traces")

ORACLE["build_samples_bias"] = with_views(f"""
    , rk AS ({ranked_sql("SELECT * FROM fx_wide_traces WHERE " + num('pga'), fx.WIDE_CHUNK)})
    SELECT sample_id, eq_id, event_copy, chunk_no, is_bias,
           count(*) FILTER (WHERE side = 'input') AS n_inputs,
           count(*) FILTER (WHERE side = 'target') AS n_targets,
           min(pos) FILTER (WHERE side = 'target') AS min_target_pos,
           max(pos) FILTER (WHERE side = 'target') AS max_target_pos
    FROM ({samples_sql('rk', bias=True)}) GROUP BY ALL""", "fx_wide_traces")

ORACLE["sample_weights"] = with_views(f"""
    , rk AS ({ranked_sql(weights_sql(traces_sql()), M)})
    SELECT sample_id, eq_id, chunk_no, is_bias, round(avg(weight), 9) AS weight, count(*) AS n_targets
    FROM ({samples_sql('rk', bias=True)}) WHERE side = 'target' GROUP BY ALL""", "fx_catalog", "fx_traces")

ORACLE["test_year_sample_summary"] = with_views(f"""
    , {_TEST_RANKED}
    SELECT eq_id, chunk_no, max(n_chunks) AS n_samples, count(*) AS n_targets,
           max({intensity8_sql('pga')}) AS max_class, round(avg(pga), 6) AS mean_label
    FROM ({samples_sql('rk')}) WHERE side = 'target' GROUP BY eq_id, chunk_no""", "fx_catalog", "fx_traces")


# --- hydration, masking, replay, features ------------------------------------

Z3 = "[CAST(0 AS FLOAT), CAST(0 AS FLOAT), CAST(0 AS FLOAT)]"


def zeros_sql(n: str) -> str:
    return f"list_transform(range({n}), lambda _i: {Z3})"


def fit_sql(w: str, length: int, cutoff: str | None = None) -> str:
    m = f"least(len({w}), {length})" if cutoff is None else f"least(len({w}), {length}, {cutoff})"
    m = f"greatest({m}, 0)"
    return f"list_concat(list_slice({w}, 1, {m}), {zeros_sql(f'{length} - {m}')})"


def peak_sql(w: str) -> str:
    return f"CAST(greatest(list_max(flatten({w})), -list_min(flatten({w}))) AS DOUBLE)"


def nonzero_sql(w: str) -> str:
    return f"CAST(len(list_filter({w}, lambda s: s[1] <> 0 OR s[2] <> 0 OR s[3] <> 0)) AS INTEGER)"


def wsum_sql(w: str) -> str:
    return f"list_sum(list_transform(flatten({w}), lambda x: CAST(x AS DOUBLE)))"


def mask_sql(src: str, sec: str, length: int, rate: int = fx.WAVE_RATE, wave: bool = True) -> str:
    """C6/C7 over rows with p_pick, pick0 (and waveform)."""
    cut = f"CAST(pick0 + ({sec}) * {rate} AS INTEGER)"
    blank = f"(coalesce(p_pick > {cut}, false) OR waveform IS NULL)" if wave else f"coalesce(p_pick > {cut}, false)"
    cols = [f"{cut} AS cutoff", f"{blank} AS blanked"]
    repl = []
    for c in ("lat", "lon", "elev", "vs30"):
        repl.append(f"CASE WHEN {blank} THEN CAST(0.0 AS DOUBLE) ELSE {c} END AS {c}")
    if wave:
        repl.append(f"CASE WHEN {blank} THEN {zeros_sql(str(length))} ELSE {fit_sql('waveform', length, cut)} END AS waveform")
    excl = "lat, lon, elev, vs30" + (", waveform" if wave else "")
    return f"SELECT * EXCLUDE ({excl}), {', '.join(repl)}, {', '.join(cols)} FROM ({src})"


W_VIEWS = ("fx_catalog", "fx_traces", "fx_traces_w", "fx_waveforms")
_RKW = f"rkw AS ({ranked_sql(traces_sql(view='fx_traces_w'), M)})"
_TEST_RKW = f"rkw AS ({ranked_sql(traces_sql('test', view='fx_traces_w'), M)})"
_MASK_STEPS = f"""
    inp AS (SELECT *, first_value(p_pick) OVER (PARTITION BY eq_id ORDER BY slot) AS pick0 FROM rkw WHERE chunk_no = 0),
    hyd AS (SELECT i.*, w.samples AS waveform FROM inp i LEFT JOIN fx_waveforms w USING (eq_id, trace_idx)),
    msk AS ({mask_sql('SELECT * FROM hyd', str(q.MASK_SEC), q.T_PAD)})"""
_MASKED = f"{_RKW},{_MASK_STEPS}"


def wave_stats_sql(w: str) -> str:
    return (f"CAST(len({w}) AS INTEGER) AS n_samples, {nonzero_sql(w)} AS n_nonzero, "
            f"round({peak_sql(w)}, 6) AS peak, round({wsum_sql(w)}, 6) AS wsum")


ORACLE["hydrate_inputs"] = with_views(f"""
    , {_RANKED}
    SELECT s.sample_id, s.slot, s.trace_idx, s.lat, s.lon, s.elev, s.vs30, s.p_pick,
           CAST(coalesce(len(w.samples), 0) AS INTEGER) AS n_samples,
           CASE WHEN w.samples IS NOT NULL THEN round({peak_sql('w.samples')}, 6) END AS peak
    FROM ({samples_sql('rk')}) s LEFT JOIN fx_waveforms w USING (eq_id, trace_idx) WHERE s.side = 'input'""",
    *W_VIEWS)

ORACLE["hydrate_from_store"] = with_views(f"""
    , {_RANKED}
    SELECT r.eq_id, r.slot, r.trace_idx, CAST(coalesce(len(w.samples), 0) AS INTEGER) AS n_samples,
           CASE WHEN w.samples IS NOT NULL THEN round({peak_sql('w.samples')}, 6) END AS peak
    FROM rk r LEFT JOIN fx_waveforms w USING (eq_id, trace_idx) WHERE r.chunk_no = 0""", *W_VIEWS)

ORACLE["hydrate_targets"] = with_views(f"""
    , {_RANKED}
    SELECT sample_id, slot, trace_idx, lat, lon, elev, vs30, round(pga, 6) AS label, p_pick, pga_time AS label_time
    FROM ({samples_sql('rk')}) WHERE side = 'target'""", "fx_catalog", "fx_traces")

ORACLE["event_traces_cropped"] = with_views(f"""
    SELECT t.eq_id, t.trace_idx, CAST(coalesce(len(list_slice(w.samples, 1, {q.T_CROP})), 0) AS INTEGER) AS n_samples,
           CASE WHEN w.samples IS NOT NULL THEN round({peak_sql(f'list_slice(w.samples, 1, {q.T_CROP})')}, 6) END AS peak,
           t.lat, t.lon, t.elev, t.p_pick
    FROM fx_traces_w t LEFT JOIN fx_waveforms w USING (eq_id, trace_idx)
    WHERE t.eq_id IN (SELECT eq_id FROM fx_catalog WHERE year = {TY})""", *W_VIEWS)

ORACLE["snapshot_slots"] = with_views(f"""
    , {_RANKED},
    s AS (SELECT sample_id, side, slot, lat, lon, elev, vs30, pga FROM ({samples_sql('rk')})),
    pads AS (SELECT sample_id, side, CAST(unnest(range(n, {M})) AS INTEGER) AS slot
             FROM (SELECT sample_id, side, count(*) AS n FROM s GROUP BY ALL) WHERE n < {M})
    SELECT sample_id, side, slot, false AS is_padding, lat, lon, elev, vs30,
           CASE WHEN side = 'target' THEN round(pga, 6) END AS label FROM s
    UNION ALL
    SELECT sample_id, side, slot, true, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE),
           CAST(0.0 AS DOUBLE), CASE WHEN side = 'target' THEN CAST(0.0 AS DOUBLE) END FROM pads""",
    "fx_catalog", "fx_traces")

ORACLE["crop_pad_mask"] = with_views(f"""
    , {_MASKED}
    SELECT eq_id, slot, trace_idx, {wave_stats_sql('waveform')} FROM msk""", *W_VIEWS)

ORACLE["blank_late_stations"] = with_views(f"""
    , {_MASKED}
    SELECT eq_id, slot, trace_idx, p_pick, pick0, cutoff, blanked, lat, lon FROM msk""", *W_VIEWS)

_LADDER = f"""
    et AS (SELECT t.*, list_slice(w.samples, 1, {q.T_CROP}) AS waveform FROM fx_traces_w t
           LEFT JOIN fx_waveforms w USING (eq_id, trace_idx)
           WHERE t.eq_id IN (SELECT eq_id FROM fx_catalog WHERE year = {TY})),
    top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY eq_id ORDER BY trace_idx) - 1 AS INTEGER) AS slot
                           FROM et) WHERE slot < {M}),
    p0 AS (SELECT *, first_value(p_pick) OVER (PARTITION BY eq_id ORDER BY slot) AS pick0 FROM top),
    lad AS (SELECT *, unnest([3, 5, 7, 10]) AS mask_sec FROM p0),
    lmsk AS ({mask_sql('SELECT * FROM lad', 'mask_sec', q.T_CROP)})"""

ORACLE["cutoff_ladder"] = with_views(f"""
    , {_LADDER}
    SELECT eq_id, mask_sec, slot, trace_idx, blanked, {nonzero_sql('waveform')} AS n_nonzero,
           round({peak_sql('waveform')}, 6) AS peak FROM lmsk""", *W_VIEWS)

_SAMPLE_INPUTS = f"""{_RKW},
    sinp AS (SELECT *, first_value(p_pick) OVER (PARTITION BY sample_id ORDER BY slot) AS pick0
             FROM ({samples_sql('rkw')}) WHERE side = 'input')"""

ORACLE["random_cutoff"] = with_views(f"""
    , {_SAMPLE_INPUTS},
    r AS (SELECT *, CAST({q.MASK_SEC} + floor({u_sql('sample_id', salt='horizon|0|0')} * {10 - q.MASK_SEC}) AS INTEGER) AS mask_sec
          FROM sinp)
    SELECT sample_id, mask_sec, count(*) AS n_inputs,
           count(*) FILTER (WHERE p_pick > CAST(pick0 + mask_sec * {fx.WAVE_RATE} AS INTEGER)) AS n_blanked
    FROM r GROUP BY sample_id, mask_sec""", *W_VIEWS)

ORACLE["station_blinding"] = with_views(f"""
    , {_SAMPLE_INPUTS},
    m AS ({mask_sql('SELECT * FROM sinp', str(q.MASK_SEC), q.T_PAD, wave=False)}),
    b AS (SELECT *, (lat <> 0 OR lon <> 0 OR elev <> 0 OR vs30 <> 0) AS nz FROM m),
    c AS (SELECT *, sum(CAST(nz AS INTEGER)) OVER (PARTITION BY sample_id) AS n,
                 {u_sql('sample_id', 'slot', salt='blind-pick|0|0')} AS u2 FROM b),
    d AS (SELECT *, CAST(floor({u_sql('sample_id', salt='blind-k|0|0')} * n) AS INTEGER) AS k,
                 row_number() OVER (PARTITION BY sample_id ORDER BY nz DESC, u2, slot) - 1 AS r FROM c)
    SELECT sample_id, slot, blanked, (nz AND r < k) AS blinded FROM d""", *W_VIEWS)

ORACLE["peak_abs_log_scale"] = with_views(f"""
    SELECT eq_id, trace_idx, round(peak, 6) AS peak, round(ln(peak + {lit(1e-8)}) / 100 + {lit(2e-4)}, 6) AS log_scale
    FROM (SELECT eq_id, trace_idx, {peak_sql('samples')} AS peak FROM fx_waveforms)""", "fx_waveforms")

ORACLE["normalised_waveform"] = with_views(f"""
    SELECT eq_id, trace_idx, round(list_max(f), 6) AS nmax, round(list_min(f), 6) AS nmin, round(list_sum(f), 6) AS nsum
    FROM (SELECT eq_id, trace_idx,
                 list_transform(flatten(samples), lambda x: CAST(x AS DOUBLE) / (peak + {lit(1e-8)}) + {lit(2e-4)}) AS f
          FROM (SELECT *, {peak_sql('samples')} AS peak FROM fx_waveforms))""", "fx_waveforms")


def _emb_sql() -> str:
    (la0, la1), (lo0, lo1), (de0, de1) = EMB_WAVELENGTHS
    d5, d10 = EMB_DIM // 5, EMB_DIM // 10

    def coef(idx, lo, hi, dim):
        return f"({lit(2 * math.pi / lo)} * pow({lit(lo / hi)}, CAST({idx} AS DOUBLE) / {lit(float(dim))}))"

    i5, i10 = "floor(j / 5)", "floor(j / 10)"
    a_lat = f"(lat * {coef(i5, la0, la1, d5)})"
    a_lon = f"(lon * {coef(i5, lo0, lo1, d5)})"
    a_dep = f"(elev * {coef(i10, de0, de1, d10)})"
    return (f"CASE WHEN j % 5 = 0 THEN sin({a_lat}) WHEN j % 5 = 1 THEN cos({a_lat}) "
            f"WHEN j % 5 = 2 THEN sin({a_lon}) WHEN j % 5 = 3 THEN cos({a_lon}) "
            f"WHEN j % 10 = 4 THEN sin({a_dep}) ELSE cos({a_dep}) END")


ORACLE["position_embedding"] = with_views(f"""
    SELECT station_id, CAST(j AS INTEGER) AS j, round({_emb_sql()}, 6) AS value
    FROM (SELECT station_id, lat, lon, elev, unnest(range(150)) AS j FROM fx_stations)""", "fx_stations")

ORACLE["padding_flags"] = with_views(f"""
    , {_LADDER},
    f AS (SELECT eq_id, mask_sec, (CAST(lat AS FLOAT) = 0 AND CAST(lon AS FLOAT) = 0 AND CAST(elev AS FLOAT) = 0) AS allz,
                 (CAST(lat AS FLOAT) <> 0 AND CAST(lon AS FLOAT) <> 0 AND CAST(elev AS FLOAT) <> 0) AS alln FROM lmsk)
    SELECT eq_id, mask_sec, CAST({M} AS INTEGER) AS n_slots,
           CAST(count(*) FILTER (WHERE NOT allz) AS INTEGER) AS n_real,
           CAST({M} - count(*) + count(*) FILTER (WHERE allz) AS INTEGER) AS n_padding,
           CAST(count(*) FILTER (WHERE alln) AS INTEGER) AS n_all_nonzero
    FROM f GROUP BY eq_id, mask_sec""", *W_VIEWS)


# --- scoring, ensemble, evaluation, IO, streaming -----------------------------

def _phi_sql(z: str) -> str:
    x = f"(({z}) / {lit(math.sqrt(2.0))})"
    t = f"(1.0 / (1.0 + {lit(ERF_P)} * abs({x})))"
    a1, a2, a3, a4, a5 = (lit(a) for a in ERF_A)
    poly = f"({t} * ({a1} + {t} * ({a2} + {t} * ({a3} + {t} * ({a4} + {t} * {a5})))))"
    y = f"(1.0 - {poly} * exp(-abs({x}) * abs({x})))"
    return f"(0.5 * (1.0 + CASE WHEN {x} < 0 THEN -{y} ELSE {y} END))"


def _model_terms(alpha: float):
    """(weight, shift of mu, sigma) of the five components."""
    e = [math.exp(-alpha * k) for k in range(5)]
    return [(x / sum(e), 0.05 * (k - 2), math.exp(0.1 * k - 1)) for k, x in enumerate(e)]


def _predict_sql(alpha: float, beta: float) -> str:
    terms = [f"{lit(w)} * ((L - {lit(beta)} * d) + {lit(s)})" for w, s, _ in _model_terms(alpha)]
    return " + ".join(terms)


def _exceed_sql(alpha: float, beta: float) -> str:
    terms = [f"{lit(w)} * (1.0 - {_phi_sql(f'(answer - ((L - {lit(beta)} * d) + {lit(s)})) / {lit(g)}')})"
             for w, s, g in _model_terms(alpha)]
    return " + ".join(terms)


_REAL4 = "(lat <> 0 OR lon <> 0 OR elev <> 0 OR vs30 <> 0)"
_PRED = f"""{_TEST_RKW},{_MASK_STEPS},
    pev AS (SELECT eq_id, max(CASE WHEN {_REAL4} THEN {peak_sql('waveform')} END) AS peak,
                   max(CASE WHEN slot = 0 THEN lat END) AS lat0, max(CASE WHEN slot = 0 THEN lon END) AS lon0
            FROM msk GROUP BY eq_id),
    ptg AS (SELECT r.eq_id, concat_ws('/', r.eq_id, 0, r.chunk_no, 0) AS sample_id, r.slot, r.p_pick,
                   r.pga_time AS label_time, r.pga AS answer, r.lat AS latitude, r.lon AS longitude,
                   r.elev AS elevation, log10(e.peak + {lit(1e-8)}) AS L,
                   sqrt((r.lat - e.lat0) * (r.lat - e.lat0) + (r.lon - e.lon0) * (r.lon - e.lon0)) AS d
            FROM rkw r JOIN pev e USING (eq_id)),
    pr AS ({" UNION ALL ".join(
        f"SELECT '{n}' AS model, *, {_predict_sql(a, b)} AS predict, {_exceed_sql(a, b)} AS exceedance FROM ptg"
        for a, b, n in q.MODEL_PARAMS)})"""

_PRED_OUT = ("SELECT model, sample_id, slot, eq_id, p_pick, label_time, round(predict, 6) AS predict, "
             "round(answer, 6) AS answer, latitude, longitude, elevation FROM pr")

ORACLE["score_two_models"] = with_views(f", {_PRED}\n{_PRED_OUT}", *W_VIEWS)
ORACLE["predictions_csv_roundtrip"] = ORACLE["score_two_models"]

ORACLE["predictions_real_only"] = with_views(f"""
    , {_PRED},
    pads AS (SELECT model, sum({M} - n) AS n_pad FROM (SELECT model, sample_id, count(*) AS n FROM pr GROUP BY ALL)
             WHERE n < {M} GROUP BY model)
    SELECT p.model, CAST(count(*) + coalesce(max(pads.n_pad), 0) AS BIGINT) AS n_rows, count(*) AS n_real,
           count(*) FILTER (WHERE answer <> 0) AS n_answer_nonzero
    FROM pr p LEFT JOIN pads USING (model) GROUP BY p.model""", *W_VIEWS)

ORACLE["mixture_mean"] = with_views(
    f", {_PRED}\nSELECT model, sample_id, slot, round(predict, 6) AS mix_mean FROM pr", *W_VIEWS)

ORACLE["exceedance"] = with_views(
    f", {_PRED}\nSELECT model, sample_id, slot, round(exceedance, 6) AS exceedance FROM pr", *W_VIEWS)

_ENS = """ens AS (SELECT sample_id, slot, any_value(eq_id) AS eq_id, avg(predict) AS predict, any_value(answer) AS answer,
                  count(DISTINCT model) AS n_models FROM pr GROUP BY sample_id, slot)"""

ORACLE["ensemble_mean"] = with_views(f"""
    , {_PRED}, {_ENS}
    SELECT sample_id, slot, eq_id, round(predict, 6) AS predict, round(answer, 6) AS answer, n_models FROM ens""",
    *W_VIEWS)


def _r2_sql(src: str, model: str) -> str:
    return f"""
    SELECT {model} AS model, count(*) AS n,
           round(CASE WHEN count(*) < 2 THEN NULL
                      WHEN sum((answer - ybar) * (answer - ybar)) = 0
                           THEN CASE WHEN sum((answer - predict) * (answer - predict)) = 0 THEN 1.0 ELSE 0.0 END
                      ELSE 1.0 - sum((answer - predict) * (answer - predict)) / sum((answer - ybar) * (answer - ybar)) END, 6) AS r2,
           round(min(answer) - 0.5, 6) AS lim_lo, round(max(answer) + 0.5, 6) AS lim_hi
    FROM (SELECT *, avg(answer) OVER (PARTITION BY {model}) AS ybar FROM ({src})
          WHERE {num('answer')} AND {num('predict')})
    GROUP BY {model}"""


ORACLE["evaluate_r2"] = with_views(f", {_PRED}\n{_r2_sql('SELECT * FROM pr', 'model')}", *W_VIEWS)
ORACLE["ensemble_report"] = with_views(
    f", {_PRED}, {_ENS}\n{_r2_sql(chr(39) + 'ensemble' + chr(39) + ' AS model, * FROM ens', 'model')}".replace(
        "FROM ('ensemble' AS model, * FROM ens)", "FROM (SELECT 'ensemble' AS model, * FROM ens)"), *W_VIEWS)

# Model b has no prediction for some events, and another answer for others.
ORACLE["ensemble_rejected"] = with_views(f"""
    , {_PRED},
    part AS (SELECT sample_id, slot, eq_id, model, CASE WHEN model = 'b' AND eq_id % 7 = 0 THEN answer + 1 ELSE answer END AS answer
             FROM pr WHERE NOT (model = 'b' AND eq_id % 5 = 0))
    SELECT sample_id, slot, eq_id, count(DISTINCT model) AS n_models, max(answer) <> min(answer) AS answer_mismatch
    FROM part GROUP BY sample_id, slot, eq_id HAVING count(DISTINCT model) <> 2 OR max(answer) <> min(answer)""", *W_VIEWS)


def _scale_lists(bounds) -> tuple[str, str]:
    ticks = [(a + b) / 2 for a, b in zip(bounds, bounds[1:])]
    ticks.append(2 * ticks[-1] - ticks[-2])
    return tuple("[" + ", ".join(lit(x) for x in xs) + "]" for xs in (bounds, ticks))


def _points_sql(prefix: str, x: str) -> str:
    bounds, ticks = _scale_lists(LOG_PGA10)
    c = intensity10_sql(x)
    return (f"{c} AS {prefix}_class, {label_sql(c)} AS {prefix}_label, round({bounds}[{c} + 1], 6) AS {prefix}_threshold, "
            f"round({ticks}[{c} + 1], 6) AS {prefix}_tick")


ORACLE["evaluation_points"] = with_views(f"""
    , {_PRED}, facts AS ({_r2_sql('SELECT * FROM pr', 'model')})
    SELECT p.model, p.sample_id, p.slot, round(p.answer, 6) AS answer, round(p.predict, 6) AS predict,
           {_points_sql('answer', 'p.answer')}, {_points_sql('predict', 'p.predict')},
           {intensity10_sql('p.answer')} = {intensity10_sql('p.predict')} AS same_class, f.n, f.r2, f.lim_lo, f.lim_hi
    FROM pr p JOIN facts f ON f.model = p.model""", *W_VIEWS)

# Every cut-off at once: the rows of an input set once per cut-off.
_SECS = "[" + ", ".join(map(str, q.CUTOFFS)) + "]"
_PRED_ALL = f"""{_TEST_RKW},
    inp AS (SELECT *, first_value(p_pick) OVER (PARTITION BY eq_id ORDER BY slot) AS pick0 FROM rkw WHERE chunk_no = 0),
    hyd AS (SELECT i.*, w.samples AS waveform, unnest({_SECS}) AS mask_sec
            FROM inp i LEFT JOIN fx_waveforms w USING (eq_id, trace_idx)),
    msk AS ({mask_sql('SELECT * FROM hyd', 'mask_sec', q.T_PAD)}),
    pev AS (SELECT eq_id, mask_sec, max(CASE WHEN {_REAL4} THEN {peak_sql('waveform')} END) AS peak,
                   max(CASE WHEN slot = 0 THEN lat END) AS lat0, max(CASE WHEN slot = 0 THEN lon END) AS lon0
            FROM msk GROUP BY eq_id, mask_sec),
    ptg AS (SELECT r.eq_id, e.mask_sec, concat_ws('/', r.eq_id, 0, r.chunk_no, 0) AS sample_id, r.slot, r.pga AS answer,
                   log10(e.peak + {lit(1e-8)}) AS L,
                   sqrt((r.lat - e.lat0) * (r.lat - e.lat0) + (r.lon - e.lon0) * (r.lon - e.lon0)) AS d
            FROM rkw r JOIN pev e USING (eq_id)),
    pr AS ({" UNION ALL ".join(f"SELECT *, {_predict_sql(a, b)} AS predict FROM ptg" for a, b, _ in q.MODEL_PARAMS)}),
    ens AS (SELECT mask_sec, sample_id, slot, avg(predict) AS predict, any_value(answer) AS answer
            FROM pr GROUP BY mask_sec, sample_id, slot)"""
ORACLE["ensemble_by_cutoff"] = with_views(
    f", {_PRED_ALL}\n{_r2_sql('SELECT * FROM ens', 'mask_sec').replace('mask_sec AS model', 'CAST(mask_sec AS INTEGER) AS mask_sec')}", *W_VIEWS)

ORACLE["point_prediction"] = with_views(f"""
    , {_PRED}
    SELECT agg, model, sample_id, slot, round(predict, 6) AS point FROM pr, (VALUES ('mean'), ('point')) v(agg)""", *W_VIEWS)

ORACLE["mixture_from_logits"] = with_views(f"""
    , mx AS (
      SELECT vec_id, w, mu, sg FROM (
        SELECT vec_id, list_transform(e, lambda x: x / (e[1] + e[2] + e[3] + e[4] + e[5])) AS w, mu, sg FROM (
          SELECT vec_id, list_transform(l, lambda x: exp(x - list_max(l))) AS e,
                 list_transform(embedding[11:15], lambda x: CAST(x AS DOUBLE)) AS mu,
                 list_transform(embedding[6:10], lambda x: exp(CAST(x AS DOUBLE))) AS sg
          FROM (SELECT vec_id, embedding, list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE)) AS l
                FROM embeddings))))
    SELECT k.eq_id, k.trace_idx,
           round(w[1] * mu[1] + w[2] * mu[2] + w[3] * mu[3] + w[4] * mu[4] + w[5] * mu[5], 6) AS mix_mean,
           round(list_max(w), 6) AS w_max, round(list_max(sg), 6) AS sigma_max,
           round(w[1] + w[2] + w[3] + w[4] + w[5], 6) AS w_sum
    FROM fx_traces k JOIN mx
      ON (k.eq_id * 7 + k.trace_idx) % (SELECT max(vec_id) + 1 + {fx.NO_WAVE} FROM embeddings) = mx.vec_id""", "fx_traces")

ORACLE["local_time"] = """
    SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_ts FROM events"""

_KINDS = f"""lk AS (SELECT DISTINCT eq_id, mask_sec, CAST(eq_id % {q.BAD_KINDS} AS INTEGER) AS kind FROM lmsk)"""

ORACLE["validate_snapshots"] = with_views(f"""
    , {_LADDER}, {_KINDS},
    lr AS (SELECT *, CASE kind WHEN 1 THEN 'corrupt' WHEN 2 THEN 'ragged_time' WHEN 3 THEN 'station_count'
                     WHEN 4 THEN 'station_count_mismatch' WHEN 5 THEN 'missing' WHEN 6 THEN 'bad_position' END AS reason FROM lk)
    SELECT reason IS NULL AS valid, reason, count(*) AS n_lines,
           count(DISTINCT CASE WHEN kind <> 1 THEN eq_id END) AS n_events FROM lr GROUP BY ALL""", *W_VIEWS)

ORACLE["validate_snapshot_lines"] = with_views(f"""
    , {_LADDER}, {_KINDS}
    SELECT CASE WHEN kind <> 1 THEN eq_id END AS eq_id, CASE WHEN kind <> 1 THEN mask_sec END AS mask_sec,
           kind IN (0, 7) AS valid, CASE kind WHEN 1 THEN 'corrupt' WHEN 2 THEN 'ragged_time' WHEN 3 THEN 'station_count'
                     WHEN 4 THEN 'station_count_mismatch' WHEN 5 THEN 'missing' WHEN 6 THEN 'bad_position' END AS reason,
           CASE WHEN kind IN (1, 5) THEN NULL WHEN kind IN (3, 4) THEN {fx.MAX_STATIONS_FX - 1} ELSE {fx.MAX_STATIONS_FX} END AS n_stations
    FROM lk""", *W_VIEWS)

_F = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
_STREAM = f"""{_LADDER},
    sst AS (SELECT eq_id, mask_sec, slot, waveform, {_F.format('lat')} AS flat, {_F.format('lon')} AS flon,
                   {_F.format('elev')} AS felev FROM lmsk),
    sev AS (SELECT eq_id, mask_sec,
                   max(CASE WHEN NOT (flat = 0 AND flon = 0 AND felev = 0) THEN {peak_sql('waveform')} END) AS peak,
                   max(CASE WHEN slot = 0 THEN flat END) AS lat0, max(CASE WHEN slot = 0 THEN flon END) AS lon0
            FROM sst GROUP BY eq_id, mask_sec),
    stg AS (SELECT s.eq_id, s.mask_sec, s.slot, s.flat AS latitude, log10(e.peak + {lit(1e-8)}) AS L,
                   sqrt((s.flat - e.lat0) * (s.flat - e.lat0) + (s.flon - e.lon0) * (s.flon - e.lon0)) AS d
            FROM sst s JOIN sev e USING (eq_id, mask_sec)
            WHERE NOT (s.flat = 0 AND s.flon = 0 AND s.felev = 0) AND e.peak IS NOT NULL),
    spr AS ({" UNION ALL ".join(f"SELECT '{n}' AS model, *, {_predict_sql(a, b)} AS predict FROM stg"
                                for a, b, n in q.MODEL_PARAMS)})"""

ORACLE["stream_scored"] = with_views(f"""
    , {_STREAM}
    SELECT eq_id, mask_sec, model, slot, round(predict, 6) AS predict FROM spr""", *W_VIEWS)


ORACLE["snapshots_batch_scored"] = ORACLE["stream_scored"]


def _route_sql() -> str:
    whens = " ".join(f"WHEN latitude >= {lit(lo)} AND latitude < {lit(hi)} THEN '{n}'" for n, lo, hi in q.ROUTES)
    return f"CASE {whens} ELSE 'other' END"


ORACLE["stream_routed"] = with_views(f"""
    , {_STREAM}
    SELECT eq_id, mask_sec, model, slot, {_route_sql()} AS route, round(predict, 6) AS predict FROM spr""", *W_VIEWS)


# Lines of kind 3 lost their last station; the stream accepts any number of stations.
_STREAM_LINES = f"""{_LADDER}, {_KINDS},
    lcut AS (SELECT l.* FROM lmsk l JOIN lk USING (eq_id, mask_sec)
             WHERE kind IN (0, 7) OR (kind = 3 AND slot < {M} - 1)),"""
_STREAM_KINDS = f"""
    , {_STREAM_LINES}
    {_STREAM.split("sst AS", 1)[0].replace(_LADDER, '').lstrip(', ')} sst AS{_STREAM.split("sst AS", 1)[1].replace('FROM lmsk', 'FROM lcut')}
    SELECT 'scored' AS kind, {_route_sql()} AS name, count(*) AS n FROM spr GROUP BY 2
    UNION ALL
    SELECT 'rejected' AS kind, CASE kind WHEN 1 THEN 'corrupt' WHEN 2 THEN 'ragged_time' WHEN 4 THEN 'station_count_mismatch'
           WHEN 5 THEN 'missing' ELSE 'bad_position' END AS name, count(*) AS n
    FROM lk WHERE kind IN (1, 2, 4, 5, 6) GROUP BY 2"""
ORACLE["stream_quarantined"] = with_views(_STREAM_KINDS, *W_VIEWS)
ORACLE["stream_restarted"] = with_views(f"""{_STREAM_KINDS}
    UNION ALL SELECT 'reported', 'snapshots', count(*) FROM lk WHERE kind IN (0, 3, 7)
    UNION ALL SELECT 'reported', 'rejected', count(*) FROM lk WHERE kind IN (1, 2, 4, 5, 6)
    UNION ALL SELECT 'reported', 'predictions', count(*) FROM spr""", *W_VIEWS)

ORACLE["stream_live_status"] = with_views(f"""
    , {_STREAM}
    SELECT 'sound' AS name, 'idle' AS state, NULL::BOOLEAN AS told, count(*) AS n_predictions FROM spr
    UNION ALL SELECT 'broken', 'failed', TRUE, 0""", *W_VIEWS)

ORACLE["stream_archived"] = with_views(f"""
    , {_STREAM}
    SELECT 'predictions' AS name, count(*) AS n FROM spr
    UNION ALL SELECT 'archived lines', count(*) FROM (SELECT DISTINCT eq_id, mask_sec FROM lmsk)
    UNION ALL SELECT 'lines left', 0""", *W_VIEWS)

ORACLE["stream_routed_by_table"] = with_views(f"""
    , {_STREAM},
    rules AS (SELECT n_nationkey % 7 AS priority, n_name AS name, {lit(21.0)} + n_nationkey * {lit(0.2)} AS lo,
                     CASE WHEN n_nationkey % 10 <> 9 THEN {lit(21.0)} + n_nationkey * {lit(0.2)} + {lit(0.9)} END AS hi FROM nation),
    won AS (SELECT latitude, arg_min(name, (priority, name)) AS route
            FROM (SELECT DISTINCT latitude FROM spr) JOIN rules ON latitude >= lo AND (hi IS NULL OR latitude < hi) GROUP BY latitude)
    SELECT eq_id, mask_sec, model, slot, coalesce(route, 'other') AS route, round(predict, 6) AS predict
    FROM spr LEFT JOIN won USING (latitude)""", *W_VIEWS)


ORACLE["canonical_tables"] = with_views("""
    SELECT 'catalog' AS name, count(*) AS n_rows, CAST(sum(year) AS BIGINT) AS total FROM fx_catalog
    UNION ALL SELECT 'traces', count(*), CAST(sum(p_pick) AS BIGINT) FROM fx_traces
    UNION ALL SELECT 'waveforms', count(*), CAST(sum(len(samples)) AS BIGINT) FROM fx_waveforms""", *W_VIEWS)


# --- the full data-set builder -------------------------------------------------

def _dataset_sql(o) -> str:
    """SQL twin of ``build_dataset`` + ``dataset_summary`` for the options ``o``."""
    T_ = o.length
    m = o.max_station_num
    lab = o.label_key
    bounds8 = LOG_PGV8 if lab == "pgv" else LOG_PGA8
    mag = lit(o.mag_threshold)
    small = ""
    if o.part_small_event:
        small = f"""UNION ALL
              SELECT * FROM fx_catalog WHERE {num('magnitude')} AND magnitude < {mag} AND year <> {o.test_year}
                AND {u_sql('eq_id', salt='small-event|' + o.seed)} < 0.25"""
    year = {"train": f"WHERE year <> {o.test_year}", "test": f"WHERE year = {o.test_year}"}.get(o.mode, "")
    limit = f"ORDER BY eq_id LIMIT {o.limit}" if o.limit else ""
    copies = (f"CASE WHEN e.magnitude >= {lit(o.oversample_mag)} THEN greatest(CAST(trunc(pow({lit(o.oversample)}, "
              f"e.magnitude - 1) - 1) AS INTEGER), 0) ELSE 0 END") if o.oversample > 1 else "0"
    down = (f"AND NOT ({lab} < {lit(LOG10_DOWNSAMPLE_BELOW)} AND "
            f"{u_sql('eq_id', 'trace_idx', salt='downsample|' + o.seed)} < 0.5)") if o.downsampling else ""
    if o.weight_label:
        weights = f"""SELECT w.*, 1.0 / h.n AS weight FROM (SELECT *, {intensity8_sql(lab, bounds8)} AS class FROM dt0) w
            JOIN (SELECT {intensity8_sql(lab, bounds8)} AS class, count(*) AS n FROM dt0 GROUP BY 1) h
              ON w.class IS NOT DISTINCT FROM h.class"""
    else:
        weights = "SELECT *, CAST(NULL AS DOUBLE) AS weight FROM dt0"
    if o.oversample_by_labels:
        tcopies = f"""SELECT * EXCLUDE (nc), CAST(unnest(range(0, nc + 1)) AS INTEGER) AS trace_copy FROM (
              SELECT *, CASE WHEN {lab} > {lit(LOG10_OVERSAMPLE_ABOVE)}
                             THEN CAST(round_even(pow(4.5, pow(1.5, {lab})) + 1, 0) AS INTEGER) ELSE 0 END AS nc
              FROM dtw)"""
    else:
        tcopies = "SELECT *, 0 AS trace_copy FROM dtw"
    order = "p_pick NULLS LAST, trace_idx, trace_copy" if o.sort_by_picks else \
        "CASE WHEN trace_copy > 0 THEN 1 ELSE 0 END, trace_idx, trace_copy"
    bias_arr = "CASE WHEN c.n_chunks > 1 THEN [false, true] ELSE [false] END" if o.bias_to_closer_station else "[false]"
    bias_tg = f"""UNION ALL
             SELECT c.eq_id, s._sc AS chunk_no, true AS is_bias, c.{lab} AS label, c.p_pick, c.{lab}_time AS label_time,
                    c.weight, c.n_copies
             FROM dc0 c JOIN dsp s USING (eq_id) WHERE c.n_chunks > 1""" if o.bias_to_closer_station else ""
    if o.mask_waveform_random:
        span = o.max_random_sec - (o.mask_waveform_sec or 0)
        sec = f"CAST({o.mask_waveform_sec or 0} + floor({u_sql('sample_id', salt=f'horizon|{o.epoch}|{o.seed}')} * {span}) AS INTEGER)"
    elif o.mask_waveform_sec:
        sec = f"CAST({o.mask_waveform_sec} AS INTEGER)"
    else:
        sec = "CAST(NULL AS INTEGER)"
    if o.mask_waveform_random or o.mask_waveform_sec:
        masked = f"dmk AS ({mask_sql('SELECT * FROM dmk0', 'mask_sec', T_, rate=o.sampling_rate)}),"
    else:
        masked = "dmk AS (SELECT *, false AS blanked FROM dmk0),"
    if o.station_blind:
        blind = f"""dbl1 AS (SELECT *, sum(CAST(nz AS INTEGER)) OVER (PARTITION BY sample_id) AS n,
                    {u_sql('sample_id', 'slot', salt=f'blind-pick|{o.epoch}|{o.seed}')} AS u2 FROM dbl0),
    dbl AS (SELECT *, nz AND (row_number() OVER (PARTITION BY sample_id ORDER BY nz DESC, u2, slot) - 1)
                       < CAST(floor({u_sql('sample_id', salt=f'blind-k|{o.epoch}|{o.seed}')} * n) AS INTEGER) AS blinded
            FROM dbl1),"""
    else:
        blind = "dbl AS (SELECT *, false AS blinded FROM dbl0),"
    sql = f"""
    dev AS (SELECT eq_id, magnitude FROM (
              SELECT * FROM fx_catalog WHERE {num('magnitude')} AND magnitude >= {mag}
              {small}) {year} {limit}),
    dt0 AS (SELECT t.*, e.magnitude, {copies} AS n_copies
            FROM fx_traces_w t JOIN dev e USING (eq_id) WHERE {num(lab)} {down}),
    dtw AS ({weights}),
    dtc AS ({tcopies}),
    drk AS (SELECT *, CAST(pos // {m} AS INTEGER) AS chunk_no, CAST(pos % {m} AS INTEGER) AS slot,
                   CAST((n_traces + {m - 1}) // {m} AS INTEGER) AS n_chunks
            FROM (SELECT *, CAST(row_number() OVER (PARTITION BY eq_id ORDER BY {order}) - 1 AS INTEGER) AS pos,
                         CAST(count(*) OVER (PARTITION BY eq_id) AS INTEGER) AS n_traces FROM dtc)),
    dc0 AS (SELECT d.* EXCLUDE (lat, lon, elev, vs30), first_value(d.p_pick) OVER (PARTITION BY d.eq_id ORDER BY d.slot) AS pick0,
                   {', '.join(f"CASE WHEN w.samples IS NULL THEN CAST(0.0 AS DOUBLE) ELSE d.{c} END AS {c}" for c in ('lat', 'lon', 'elev', 'vs30'))},
                   CASE WHEN w.samples IS NULL THEN {zeros_sql(str(T_))} ELSE {fit_sql('w.samples', T_)} END AS waveform
            FROM drk d LEFT JOIN fx_waveforms w USING (eq_id, trace_idx) WHERE d.chunk_no = 0),
    dsp AS (SELECT eq_id, chunk_no AS _sc FROM drk WHERE slot = 0),
    dinp0 AS (SELECT c.* EXCLUDE (chunk_no), s._sc AS chunk_no, unnest({bias_arr}) AS is_bias
              FROM dc0 c JOIN dsp s USING (eq_id)),
    dinp AS (SELECT *, concat_ws('/', eq_id, event_copy, chunk_no, CAST(is_bias AS INTEGER)) AS sample_id FROM (
               SELECT *, CAST(unnest(range(0, n_copies + 1)) AS INTEGER) AS event_copy FROM dinp0)),
    dmk0 AS (SELECT *, {sec} AS mask_sec FROM dinp),
    {masked}
    dbl0 AS (SELECT *, {_REAL4} AS nz FROM dmk),
    {blind}
    dig AS (SELECT sample_id, any_value(mask_sec) AS mask_sec,
                   count(*) FILTER (WHERE nz AND NOT blinded) AS n_real_inputs,
                   max(CASE WHEN blinded THEN 0.0 ELSE {peak_sql('waveform')} END) AS peak
            FROM dbl GROUP BY sample_id),
    dtg0 AS (SELECT eq_id, chunk_no, false AS is_bias, {lab} AS label, p_pick, {lab}_time AS label_time, weight, n_copies
             FROM drk {bias_tg}),
    dtg AS (SELECT concat_ws('/', eq_id, event_copy, chunk_no, CAST(is_bias AS INTEGER)) AS sample_id,
                   event_copy, chunk_no, is_bias, label, p_pick, label_time, weight FROM (
              SELECT *, CAST(unnest(range(0, n_copies + 1)) AS INTEGER) AS event_copy FROM dtg0)),
    dtgg AS (SELECT sample_id, any_value(event_copy) AS event_copy, any_value(chunk_no) AS chunk_no,
                    any_value(is_bias) AS is_bias, count(*) AS n, sum(label) AS label_sum, avg(weight) AS weight,
                    sum(p_pick) AS p_pick_sum, sum(label_time) AS label_time_sum
             FROM dtg GROUP BY sample_id)
    SELECT t.sample_id, t.event_copy, t.chunk_no, t.is_bias, i.mask_sec, CAST({m} AS INTEGER) AS n_inputs,
           CAST(i.n_real_inputs AS INTEGER) AS n_real_inputs,
           CAST(greatest(t.n, {o.label_target}) AS INTEGER) AS n_targets, CAST(t.n AS INTEGER) AS n_real_targets,
           round(i.peak, 6) AS peak, round(t.label_sum, 6) AS label_sum"""
    if o.weight_label:
        sql += ", round(t.weight, 9) AS weight"
    if o.mode != "train":
        sql += ", CAST(t.p_pick_sum AS BIGINT) AS p_pick_sum, CAST(t.label_time_sum AS BIGINT) AS label_time_sum"
    return sql + "\n    FROM dtgg t JOIN dig i USING (sample_id)"


ORACLE["dataset_samples"] = with_views(", " + _dataset_sql(q.dataset_options()), *W_VIEWS)
ORACLE["dataset_test_samples"] = with_views(", " + _dataset_sql(q.dataset_test_options()), *W_VIEWS)

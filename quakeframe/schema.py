"""Table schemas and the fixed values the results depend on."""

from __future__ import annotations

import math

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the original definitions for right results)
# ---------------------------------------------------------------------------
# 10-class intensity scale: labels and lower bounds in m/s^2 (PGA) and m/s (PGV).
INTENSITY10_LABELS = ["0", "1", "2", "3", "4", "5-", "5+", "6-", "6+", "7"]
INTENSITY10_PGA = [1e-5, 0.008, 0.025, 0.080, 0.250, 0.80, 1.4, 2.5, 4.4, 8.0]
INTENSITY10_PGV = [1e-5, 0.002, 0.007, 0.019, 0.057, 0.15, 0.3, 0.5, 0.8, 1.4]
# 8-class scale used for label balancing (5-/5+ and 6-/6+ merged).
INTENSITY8_PGA = [0.008, 0.025, 0.08, 0.25, 0.8, 2.5, 8]
INTENSITY8_PGV = [0.002, 0.007, 0.019, 0.057, 0.15, 0.5, 1.4]
# Balancing cut-offs (m/s or m/s^2 before log10): weak-motion down-sampling and
# strong-motion over-sampling.
DOWNSAMPLE_BELOW = 0.019
OVERSAMPLE_ABOVE = 0.057
# Trace over-sampling: extra copies = round_half_even(BASE ** (EXP ** label) + 1).
TRACE_COPY_BASE = 4.5
TRACE_COPY_EXP = 1.5
# Position-embedding wavelength ranges: (min, max) for latitude, longitude, depth.
EMB_WAVELENGTHS = ((5.0, 30.0), (110.0, 123.0), (0.01, 5000.0))
EMB_DIM = 150
# Numerical guards of the waveform features.
PEAK_EPS = 1e-8
LAYER_EPS = 1e-4
# Mixture size of the model output.
N_COMPONENTS = 5
# Replay defaults: cut-offs in seconds, stations per snapshot, 15 s at 200 Hz.
LADDER_SECS = [3, 5, 7, 10]
MAX_STATIONS = 25
SAMPLING_RATE = 200
DATA_LENGTH_SEC = 15
LOCAL_TZ = "Asia/Taipei"
# ---------------------------------------------------------------------------

LOG10_DOWNSAMPLE_BELOW = math.log10(DOWNSAMPLE_BELOW)
LOG10_OVERSAMPLE_ABOVE = math.log10(OVERSAMPLE_ABOVE)

FLOAT_ARRAY = T.ArrayType(T.FloatType(), True)
WAVEFORM_TYPE = T.ArrayType(FLOAT_ARRAY, True)          # [time][component]
SNAPSHOT_WAVEFORM_TYPE = T.ArrayType(WAVEFORM_TYPE, True)  # [station][time][component]
STATION_TYPE = T.ArrayType(FLOAT_ARRAY, True)           # [station][lat, lon, elev(, vs30)]

EVENTS_CATALOG = T.StructType([
    T.StructField("eq_id", T.LongType(), False),
    T.StructField("year", T.IntegerType(), True),
    T.StructField("magnitude", T.DoubleType(), True),
])

TRACES = T.StructType([
    T.StructField("eq_id", T.LongType(), False),
    T.StructField("trace_idx", T.IntegerType(), False),
    T.StructField("station_name", T.StringType(), True),
    T.StructField("lat", T.DoubleType(), True),
    T.StructField("lon", T.DoubleType(), True),
    T.StructField("elev", T.DoubleType(), True),
    T.StructField("vs30", T.DoubleType(), True),
    T.StructField("p_pick", T.IntegerType(), True),
    T.StructField("pga", T.DoubleType(), True),
    T.StructField("pga_time", T.IntegerType(), True),
    T.StructField("pgv", T.DoubleType(), True),
    T.StructField("pgv_time", T.IntegerType(), True),
])

WAVEFORMS = T.StructType([
    T.StructField("eq_id", T.LongType(), False),
    T.StructField("trace_idx", T.IntegerType(), False),
    T.StructField("samples", WAVEFORM_TYPE, True),
])

# JSON snapshot line, as produced by the replay and read by the stream.
SNAPSHOT = T.StructType([
    T.StructField("event_time", T.TimestampType(), True),
    T.StructField("waveform", SNAPSHOT_WAVEFORM_TYPE, True),
    T.StructField("station", STATION_TYPE, True),
])

# Same, with the identifying columns our writer adds and the corrupt-record column.
SNAPSHOT_READ = T.StructType(SNAPSHOT.fields + [
    T.StructField("eq_id", T.LongType(), True),
    T.StructField("mask_sec", T.IntegerType(), True),
    T.StructField("_corrupt_record", T.StringType(), True),
])

MIXTURE_TYPE = T.ArrayType(T.StructType([
    T.StructField("weight", T.DoubleType(), True),
    T.StructField("mu", T.DoubleType(), True),
    T.StructField("sigma", T.DoubleType(), True),
]), True)

PREDICTIONS_CSV = T.StructType([
    T.StructField("model", T.StringType(), True),
    T.StructField("sample_id", T.StringType(), True),
    T.StructField("slot", T.IntegerType(), True),
    T.StructField("eq_id", T.LongType(), True),
    T.StructField("p_pick", T.IntegerType(), True),
    T.StructField("label_time", T.IntegerType(), True),
    T.StructField("predict", T.DoubleType(), True),
    T.StructField("answer", T.DoubleType(), True),
    T.StructField("latitude", T.DoubleType(), True),
    T.StructField("longitude", T.DoubleType(), True),
    T.StructField("elevation", T.DoubleType(), True),
])

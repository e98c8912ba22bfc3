"""Seismic views over the driver's test tables (FIXTURES.md part B).

Each view exists twice: as a DataFrame builder (used by the registered queries) and as a
SQL common table expression (used by the DuckDB oracles). Both read the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixture parameters (FIXTURES.md B1-B5).
TEST_YEAR = 2000
MAX_STATIONS_FX = 4
WIDE_CHUNK = 25
WAVE_RATE = 2            # samples per second of the fixture waveforms
WAVE_SAMPLES = 22        # 22 samples x 3 components from a 64-float embedding (2 zeros at the end)
WAVE_PICK_DIVISOR = 100  # fixture pick in waveform samples = p_pick / 100
NO_WAVE = 3              # trace -> vector link: (eq_id*7 + trace_idx) % (vectors + 3); the last 3 have no waveform

BROADCAST_STATIONS = 500_000  # of some 100 bytes each

NAN = float("nan")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fx_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: event catalogue from orders (eq_id unique, starts at 0; 1 in 97 NaN magnitudes)."""
    o = read_table(spark, sf_dir, "orders")
    mag = F.round(F.lit(1.0) + F.lit(6.0) * F.col("o_totalprice") / F.lit(500000.0), 2)
    return o.select(
        F.col("o_orderkey").alias("eq_id"),
        F.year("o_orderdate").cast("int").alias("year"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit(NAN)).otherwise(mag).alias("magnitude"),
    )


def _station_cols(key: str):
    k = F.col(key)
    return [
        (F.lit(21.5) + (F.lit(4) * (k % 1000)).cast("double") / 1000).alias("lat"),
        (F.lit(119.5) + (F.lit(3) * ((k * 7) % 1000)).cast("double") / 1000).alias("lon"),
        (((k * 13) % 4000).cast("double") / 1000).alias("elev"),
        (F.lit(200) + k % 600).cast("double").alias("vs30"),
    ]


def fx_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station positions from supplier (key 0 sits at elevation 0)."""
    s = read_table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("station_id"),
                    F.col("s_name").alias("station_name"), *_station_cols("s_suppkey"))


LINE_COLUMNS = ["l_orderkey", "trace_idx", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount"]


def numbered_lines(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The lines with their ``trace_idx`` in the order, of the ``events`` (``eq_id``) only if given: the
    lines of others are dropped before the numbering, which they cannot change. Spark itself moves
    a semi join below the window only while it can broadcast the events. A caller that wants traces
    and waveforms keeps their ``LINE_COLUMNS`` (``pinned``) and passes them to both as ``lines``, so
    that the lines are shuffled and numbered once."""
    li = read_table(spark, sf_dir, "lineitem")
    if events is not None:
        li = li.join(events.select(F.col("eq_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return li.withColumn("trace_idx", (F.row_number().over(w) - 1).cast("int"))


def fx_traces(spark: SparkSession, sf_dir: str, pick_divisor: int = 1, events: DataFrame | None = None,
              lines: DataFrame | None = None) -> DataFrame:
    """B2 + B3: one row per trace with position, pick and labels (log10 PGA/PGV). Stations are broadcast up to
    a counted bound; more are joined by a shuffle."""
    li = lines if lines is not None else numbered_lines(spark, sf_dir, events)
    pick = F.col("l_quantity") * 20
    no_label = (F.col("l_tax") == 0) & (F.col("l_discount") == 0)
    t = li.select(
        F.col("l_orderkey").alias("eq_id"),
        "trace_idx",
        F.col("l_suppkey").alias("station_id"),
        pick.cast("int").alias("p_raw"),
        F.when(no_label, F.lit(NAN)).otherwise(F.log10(F.col("l_extendedprice") / 13000)).alias("pga"),
        F.when(no_label, F.lit(NAN)).otherwise(F.log10(F.col("l_extendedprice") / 70000)).alias("pgv"),
        (pick.cast("int") + 50 * F.col("l_linenumber")).cast("int").alias("label_time"),
    )
    if pick_divisor != 1:
        p = F.floor(F.col("p_raw") / pick_divisor).cast("int")
    else:
        p = F.col("p_raw")
    t = t.withColumn("p_pick", p)
    st = fx_stations(spark, sf_dir)
    if st.count() <= BROADCAST_STATIONS:  # the lines stay where their event's are
        st = F.broadcast(st)
    return t.join(st, "station_id").select(
        "eq_id", "trace_idx", "station_name", "lat", "lon", "elev", "vs30", "p_pick",
        "pga", F.col("label_time").alias("pga_time"), "pgv", F.col("label_time").alias("pgv_time"))


def fx_wide_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """49-86 traces per event from the events table, for chunks of 25 stations.
    Positions follow the B3 formulas keyed by event_id."""
    e = read_table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(
        F.col("user_id").alias("eq_id"),
        (F.row_number().over(w) - 1).cast("int").alias("trace_idx"),
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("station_name"),
        *_station_cols("event_id"),
        F.floor(F.col("value") * 10).cast("int").alias("p_pick"),
        F.when(F.col("value") > 0, F.log10(F.col("value") / 50)).alias("pga"),
        (F.floor(F.col("value") * 10) + 100).cast("int").alias("pga_time"),
        F.when(F.col("value") > 0, F.log10(F.col("value") / 250)).alias("pgv"),
        (F.floor(F.col("value") * 10) + 100).cast("int").alias("pgv_time"),
    )


def fx_trace_vectors(spark: SparkSession, sf_dir: str, events: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """The vector id of every trace: all vectors are used, and a few traces have none. Kept lines are
    dealt by event first: beside few vectors (a broadcast), no samples are shuffled to their event after."""
    if lines is not None:
        li = lines.repartition("l_orderkey")
    elif events is not None:
        li = numbered_lines(spark, sf_dir, events)
    else:  # the numbers of an order are 0 to its lines less one, whatever their order: counts are shuffled, not lines
        n = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
        li = n.select("l_orderkey", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("trace_idx"))
    keys = li.select(F.col("l_orderkey").alias("eq_id"), "trace_idx")
    n = read_table(spark, sf_dir, "embeddings").select(F.max("vec_id") + (1 + NO_WAVE)).scalar()
    return keys.withColumn("vec_id", (F.col("eq_id") * 7 + F.col("trace_idx")) % n)


def fx_waveforms(spark: SparkSession, sf_dir: str, events: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """A 22 x 3 waveform per trace, samples[t][c] = embedding[3t + c] of the linked vector
    (zero beyond its end); no row for the traces that have no vector."""
    at = lambda i: F.coalesce(F.get("embedding", i), F.lit(0.0).cast("float"))
    shaped = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform(F.sequence(F.lit(0), F.lit(WAVE_SAMPLES - 1)),
                              lambda t: F.array(at(3 * t), at(3 * t + 1), at(3 * t + 2))).alias("samples"))
    return fx_trace_vectors(spark, sf_dir, events, lines).join(shaped, "vec_id").select("eq_id", "trace_idx", "samples")


# ---------------------------------------------------------------------------
# The same views as SQL (DuckDB dialect) for the oracles.
# ---------------------------------------------------------------------------

def _station_sql(k: str) -> str:
    return (f"CAST(21.5 AS DOUBLE) + CAST(4 * ({k} % 1000) AS DOUBLE) / 1000 AS lat, "
            f"CAST(119.5 AS DOUBLE) + CAST(3 * (({k} * 7) % 1000) AS DOUBLE) / 1000 AS lon, "
            f"CAST((({k} * 13) % 4000) AS DOUBLE) / 1000 AS elev, "
            f"CAST(200 + {k} % 600 AS DOUBLE) AS vs30")


SQL_VIEWS = {
    "fx_catalog": """
        SELECT o_orderkey AS eq_id, CAST(year(o_orderdate) AS INTEGER) AS year,
               CASE WHEN o_orderkey % 97 = 0 THEN CAST('NaN' AS DOUBLE)
                    ELSE round(CAST(1.0 AS DOUBLE) + CAST(6.0 AS DOUBLE) * o_totalprice / CAST(500000.0 AS DOUBLE), 2)
               END AS magnitude
        FROM orders""",
    "fx_stations": f"""
        SELECT s_suppkey AS station_id, s_name AS station_name, {_station_sql('s_suppkey')}
        FROM supplier""",
    "fx_lines": """
        SELECT l_orderkey AS eq_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
                    l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS trace_idx,
               l_suppkey AS station_id,
               CAST(l_quantity * 20 AS INTEGER) AS p_raw,
               CASE WHEN l_tax = 0 AND l_discount = 0 THEN CAST('NaN' AS DOUBLE)
                    ELSE log10(l_extendedprice / 13000) END AS pga,
               CASE WHEN l_tax = 0 AND l_discount = 0 THEN CAST('NaN' AS DOUBLE)
                    ELSE log10(l_extendedprice / 70000) END AS pgv,
               CAST(CAST(l_quantity * 20 AS INTEGER) + 50 * l_linenumber AS INTEGER) AS label_time
        FROM lineitem""",
    "fx_traces": """
        SELECT t.eq_id, t.trace_idx, s.station_name, s.lat, s.lon, s.elev, s.vs30,
               t.p_raw AS p_pick, t.pga, t.label_time AS pga_time, t.pgv, t.label_time AS pgv_time
        FROM fx_lines t JOIN fx_stations s ON t.station_id = s.station_id""",
    "fx_traces_w": """
        SELECT t.eq_id, t.trace_idx, s.station_name, s.lat, s.lon, s.elev, s.vs30,
               CAST(floor(t.p_raw / 100) AS INTEGER) AS p_pick, t.pga, t.label_time AS pga_time,
               t.pgv, t.label_time AS pgv_time
        FROM fx_lines t JOIN fx_stations s ON t.station_id = s.station_id""",
    "fx_wide_traces": f"""
        SELECT user_id AS eq_id,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS trace_idx,
               'E' || CAST(event_id AS VARCHAR) AS station_name, {_station_sql('event_id')},
               CAST(floor(value * 10) AS INTEGER) AS p_pick,
               CASE WHEN value > 0 THEN log10(value / 50) END AS pga,
               CAST(floor(value * 10) + 100 AS INTEGER) AS pga_time,
               CASE WHEN value > 0 THEN log10(value / 250) END AS pgv,
               CAST(floor(value * 10) + 100 AS INTEGER) AS pgv_time
        FROM events""",
    "fx_vectors": f"""
        SELECT vec_id, list_transform(range({WAVE_SAMPLES}),
               lambda t: [coalesce(embedding[3 * t + 1], 0), coalesce(embedding[3 * t + 2], 0),
                          coalesce(embedding[3 * t + 3], 0)]) AS samples
        FROM embeddings""",
    "fx_waveforms": f"""
        SELECT k.eq_id, k.trace_idx, v.samples
        FROM fx_lines k JOIN fx_vectors v
          ON (k.eq_id * 7 + k.trace_idx) % (SELECT max(vec_id) + 1 + {NO_WAVE} FROM embeddings) = v.vec_id""",
}

# Dependencies between the views, so a query only materialises what it uses.
_DEPS = {
    "fx_traces": ["fx_lines", "fx_stations"],
    "fx_traces_w": ["fx_lines", "fx_stations"],
    "fx_waveforms": ["fx_lines", "fx_vectors"],
}
_ORDER = list(SQL_VIEWS)


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with the CTEs it needs (in dependency order)."""
    need: set[str] = set()

    def add(v):
        if v in need:
            return
        for d in _DEPS.get(v, []):
            add(d)
        need.add(v)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in _ORDER if v in need)
    return f"WITH {ctes}\n{body}" if ctes else body

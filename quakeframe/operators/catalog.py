"""Event selection: magnitude filter, small-event sample, year split, limit, data matching.

All filters are plain column predicates on the catalogue, so Catalyst pushes them into the
Parquet scan; joins against trace data are semi/anti joins on ``eq_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.functions.portable import ge, hash_uniform, lt
from quakeframe.operators.ranking import group_positions

DRAW_BINS = 1 << 16


def select_events(catalog: DataFrame, mag_threshold: float = 0.0, part_small_event: bool = False,
                  test_year: int = 2018, small_fraction: float = 0.25, seed: str = "0",
                  exact: bool = False) -> DataFrame:
    """F1 (+F2): events with ``magnitude >= mag_threshold``; NaN/NULL magnitudes never pass.

    With ``part_small_event``, add a deterministic ``small_fraction`` sample of the smaller
    events outside ``test_year`` (so they can never reach the test split): a Bernoulli
    draw per event, or with ``exact`` the ``round_half_even(fraction * n)`` events with the
    smallest draws (like ``sample(frac=...)``, see ``smallest_draws``). The ``is_small`` column
    marks the sampled rows.
    """
    big = catalog.filter(ge("magnitude", mag_threshold)).withColumn("is_small", F.lit(False))
    if not part_small_event:
        return big
    cand = catalog.filter(lt("magnitude", mag_threshold) & (F.col("year") != test_year))
    u = hash_uniform("eq_id", salt=f"small-event|{seed}")
    small = smallest_draws(cand, u, small_fraction) if exact else cand.filter(u < small_fraction)
    return big.unionByName(small.withColumn("is_small", F.lit(True)))


def smallest_draws(rows: DataFrame, draw, fraction: float, id_col: str = "eq_id") -> DataFrame:
    """The ``round_half_even(fraction * n)`` rows with the smallest draws (ties: smaller id).

    The draws, uniform in [0, 1), are counted in ``DRAW_BINS`` equal bins; the counts (at most
    that many rows) say in which bin the last row to be taken lies. Bins below it are kept by a
    filter alone; only its own rows, a 65,536th of all, are put in order."""
    bin_ = F.floor(draw * DRAW_BINS)
    counts = dict(rows.groupBy(bin_.alias("b")).count().collect())
    n = sum(counts.values())
    left = round(n * float(fraction))  # half to even
    if left >= n:
        return rows
    for border in sorted(counts):
        if left <= counts[border]:
            break
        left -= counts[border]
    else:
        return rows.limit(0)
    last = rows.filter(bin_ == border).orderBy(draw, id_col).limit(left)
    return rows.filter(bin_ < border).unionByName(last)


def split_by_year(events: DataFrame, mode: str = "train", test_year: int = 2018,
                  year_col: str = "year") -> DataFrame:
    """``train`` keeps other years, ``test`` keeps ``test_year``, any other mode keeps all."""
    y = F.col(year_col).cast("int")
    if mode == "train":
        return events.filter(y != test_year)
    if mode == "test":
        return events.filter(y == test_year)
    return events


def first_events(events: DataFrame, limit: int | None, order_col: str = "eq_id") -> DataFrame:
    """first ``limit`` events in ``order_col`` order (None or 0 keeps all).

    The order must be explicit: file order is not defined in a distributed scan. The limit may
    be most of the catalogue, so no task merges the first rows of all others: events are range
    partitioned on the order, counted per partition, and keep their position as the count of
    the partitions before plus the place in their own (``group_positions``).
    """
    if not limit:
        return events
    columns = events.columns
    placed = group_positions(events.withColumn("__qf_all", F.lit(0)), ["__qf_all"], [order_col], pos_col="__qf_pos",
                             size_col=None, pos_type="long")
    return placed.filter(F.col("__qf_pos") < int(limit)).select(*columns)


def replay_event_ids(catalog: DataFrame, year: int) -> DataFrame:
    """ids of the events of one year, for replay."""
    return catalog.filter(F.col("year") == year).select("eq_id")


def match_events(events: DataFrame, traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split selected events into those with stored trace data and those without.

    Returns ``(matched, skipped)``; ``skipped.count()`` is the reference's skip counter.
    Only the distinct ``eq_id`` projection of the traces is shuffled (after map-side
    de-duplication), never the trace rows themselves.
    """
    keys = traces.select("eq_id").distinct()
    return events.join(keys, "eq_id", "left_semi"), events.join(keys, "eq_id", "left_anti")


def check_unique_events(catalog: DataFrame) -> DataFrame:
    """Ids that occur more than once (empty when the catalogue is valid)."""
    return catalog.groupBy("eq_id").count().filter(F.col("count") > 1)


def assert_unique_events(catalog: DataFrame) -> None:
    """Fail fast on a catalogue with duplicate ``eq_id`` (one small aggregation job)."""
    dup = check_unique_events(catalog).limit(1).collect()
    if dup:
        raise ValueError(f"event catalogue has duplicate eq_id {dup[0]['eq_id']}")

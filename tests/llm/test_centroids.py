"""Centroid clustering: against plain integer k-means."""

import random
from hashlib import sha256
from math import floor, inf, nan

import numpy as np
import pyarrow as pa
import pytest

from quakeframe.llm import centroid_clusters as C

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string"


def _brute(rows, dims, k, rounds, scale=64):
    """{result row: count} of (id, vector) rows, for ids that are unique or null."""
    kept = [(i, tuple(floor(max(-C.LIMIT, min(C.LIMIT, scale * x))) for x in v)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and abs(x) < inf for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in seeds[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        to = [j for _, j in assign()]
        for j in range(len(cents)):
            own = [v for (_, v), t in zip(kept, to) if t == j]
            if own:
                cents[j] = tuple(sum(x) // len(own) for x in zip(*own))
    last = assign()
    far = [sum(d for d, j in last if j == c) for c in range(len(cents))]
    fit = lambda x: x if x < 2**63 else None
    return sorted(((i, j, d, fit(far[j]), fit(sum(far)), sha256(",".join(map(str, cents[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, last)), key=str)


def _got(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "mine", "mine") for i, v in rows], SCHEMA)
    return sorted(map(tuple, C.centroid_clusters(df, **how).collect()), key=str)


def _rows(n, dims, seed):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 0.3) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("dims,block,rows", [(6, 2, 1 << 16), (7, 3, 10), (5, 1, 1), (4, 9, 64)])
def test_clusters(spark, monkeypatch, dims, block, rows):
    """Uneven blocks, chunks of few rows."""
    monkeypatch.setattr(C, "ROWS", rows)
    data = _rows(200, dims, dims)
    data += [(1000 + i, data[3][1]) for i in range(150)]  # one vector many times
    data += [(2000 + i, [0.0] * dims) for i in range(30)]
    assert _got(spark, data, dims=dims, clusters=9, block=block) == _brute(data, dims, 9, 3)


def test_odd_vectors(spark):
    data = _rows(40, 4, 1)
    data += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0, 3.0]), (104, [1.0, nan, 2.0, 3.0]),
             (105, [1.0, inf, 2.0, 3.0]), (106, [1.0, 2.0, -inf, 3.0]), (107, [0.0] * 5), (108, [-0.0, -1e-300, 1e-300, 0.015625]),
             (109, [1e300, -1e300, 1.7e308, 5.0]), (None, [0.5, 0.5, 0.5, 0.5]), (None, [0.25, 0.5, 0.5, 0.5])]
    for k in (3, 16, 100):  # more clusters than vectors too
        assert _got(spark, data, dims=4, clusters=k) == _brute(data, 4, k, 3)


def test_sums_that_do_not_fit(spark):
    data = [(i, [(-1.0) ** i * 1e300] * 64) for i in range(40)]
    got = _got(spark, data, clusters=1, rounds=0)
    assert got == _brute(data, 64, 1, 0) and got[0][4] is None


def test_repeated_ids_and_rows(spark):
    """Rows that share an id are judged each on its own; equal rows alike."""
    data = _rows(30, 4, 2) + [(5, [0.1, 0.2, 0.3, 0.4])] * 3
    got = _got(spark, data, dims=4, clusters=5)
    assert len(got) == 33 and sum(n == 5 for n, *_ in got) == 4
    assert len({r for r in got if r[0] == 5}) <= 2


def test_no_rows_no_rounds(spark):
    assert _got(spark, []) == []
    assert _got(spark, [(1, None)]) == []
    data = _rows(20, 64, 3)
    assert _got(spark, data, rounds=0) == _brute(data, 64, 16, 0)


def test_spread_does_not_matter(spark):
    data = _rows(300, 8, 4)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    a, b = (sorted(map(tuple, C.centroid_clusters(x, dims=8).collect())) for x in (df.coalesce(1), df.repartition(7)))
    assert a == b


def test_encode_is_lossless():
    r = np.random.default_rng(1)
    for width in (1, 2, 5):
        rows = r.integers(-3, 4, (500, width))
        entries, codes = C.encode(rows)
        assert (entries[codes] == rows).all() and len({tuple(e) for e in entries}) == len(entries)


@pytest.mark.parametrize("abreast", [1, 3, 7, 64])
def test_centroids_in_parts(monkeypatch, abreast):
    monkeypatch.setattr(C, "ABREAST", abreast)
    r = np.random.default_rng(2)
    rows, cents = r.integers(-9, 10, (300, 7)), r.integers(-9, 10, (7, 7))
    cents[5] = cents[2]  # a tie
    packed = next(C._pack(7, 1, 2)(iter([pa.RecordBatch.from_arrays(
        [pa.array(range(300)), pa.array(rows.astype(float).tolist())], ["id", "vector"])])))
    [(ids, chunk)] = C._chunks([packed], 7, 2)
    cluster, distance = chunk.nearest(cents)
    far = ((rows[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (cluster == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all() and ids.to_pylist() == list(range(300))
    assert (chunk.sums(cluster, 7) == [rows[cluster == c].sum(axis=0) for c in range(7)]).all()

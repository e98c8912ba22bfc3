"""Centroid clustering with subvector dictionaries.

Vectors become integers, floor(scale * x) per component. They are packed into chunks of up to
``ROWS`` vectors, and each block of ``block`` dimensions of a chunk is dictionary-encoded without
loss: the distinct subvectors, and one code per vector. The packed table is written once.

A round needs, per chunk, the exact squared distance of each distinct subvector to the same
block of each centroid, once; a vector's distance is the sum of the partial distances at its
codes. New centroids come from the dictionaries as well: how often each code is in a cluster,
times its subvector. All of it is integer arithmetic, so the result does not depend on how rows
are spread. A task sends one row per cluster and block of dimensions, whatever the rows it has;
the driver sees the k centroids only.

Dictionaries belong to their chunk, so they are bounded by its rows for any data, need no
broadcast, and a vector that makes up a third of the table is one entry in each. Integers beyond
2^27 either way are clamped there, so that a distance fits a long.

Edge cases: rows whose vector is null, has another number of components, or has a null or
non-finite one are left out; a null id is kept (its seed hash is null, it is the last choice
as a first centroid); rows that share an id are judged each by its own vector, equal ones may
seed two centroids (the second stays empty: ties go to the smaller number); fewer kept vectors
than k give fewer centroids; an empty table gives an empty result; sums of distances that do
not fit a long are null; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import pick, pinned, read

DIMS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
SEED = 1
BLOCK = 2  # dimensions of a dictionary
ROWS = 1 << 16  # vectors of a chunk
LIMIT = 1 << 27
ABREAST = 64  # centroids whose distances are held side by side


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):  # beyond the largest double is beyond LIMIT too
        return np.clip(np.floor(x * float(scale)), -LIMIT, LIMIT).astype(np.int64)


def encode(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a block of dimensions, and each row's code."""
    key = rows[:, 0]
    for c in range(1, rows.shape[1]):  # codes of the columns so far and the next one
        _, one = np.unique(key, return_inverse=True)
        _, two = np.unique(rows[:, c], return_inverse=True)
        key = one * (int(two.max()) + 1) + two
    _, at, codes = np.unique(key, return_index=True, return_inverse=True)
    return rows[at], codes


def partial_distances(subvectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of a dictionary's entries to the same block of every centroid."""
    gap = subvectors[:, None, :] - centroids[None, :, :]
    return (gap * gap).sum(axis=2)


def _code_type(entries: int):
    return np.uint16 if entries <= 1 << 16 else np.uint32


class Chunk:
    """The dictionaries of one packed row."""

    def __init__(self, subvectors: list[bytes], codes: list[bytes], dims: int, block: int):
        self.at = [(a, min(a + block, dims)) for a in range(0, dims, block)]
        self.subvectors = [np.frombuffer(s, np.int32).astype(np.int64).reshape(-1, b - a) for s, (a, b) in zip(subvectors, self.at)]
        self.codes = [np.frombuffer(c, _code_type(len(s))) for c, s in zip(codes, self.subvectors)]

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each vector; ties go to the smaller number."""
        best = distance = None
        for j in range(0, len(centroids), ABREAST):
            total = 0
            for s, c, (a, b) in zip(self.subvectors, self.codes, self.at):
                total = total + partial_distances(s, centroids[j: j + ABREAST, a:b])[c]
            here = total.argmin(axis=1)
            low = total[np.arange(len(here)), here]
            if best is None:
                best, distance = here, low
            else:
                less = low < distance
                best, distance = np.where(less, here + j, best), np.where(less, low, distance)
        return best, distance

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Componentwise sums of the vectors of each cluster: how often it has each code."""
        out = np.zeros((k, self.at[-1][1]), np.int64)
        for s, c, (a, b) in zip(self.subvectors, self.codes, self.at):
            pair, often = np.unique(cluster * len(s) + c, return_counts=True)
            np.add.at(out[:, a:b], pair // len(s), often[:, None] * s[pair % len(s)])
        return out


def _pack(dims: int, scale: int, block: int):
    def packed(ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        ids, rows = pa.concat_arrays(ids), np.concatenate(rows)
        parts = [encode(rows[:, a: a + block]) for a in range(0, dims, block)]
        subvectors = [s.astype(np.int32).tobytes() for s, _ in parts]
        codes = [c.astype(_code_type(len(s))).tobytes() for s, c in parts]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             *[pa.array([x], pa.list_(pa.binary())) for x in (subvectors, codes)]], ["ids", "subvectors", "codes"])

    def run(batches):
        ids, rows, n = [], [], 0
        for batch in batches:
            col = batch.column("vector")
            flat = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for i in range(0, batch.num_rows, ROWS):
                ids.append(batch.column("id").slice(i, ROWS))
                rows.append(integers(flat[i: i + ROWS], scale))
                n += len(ids[-1])
                if n >= ROWS:
                    yield packed(ids, rows)
                    ids, rows, n = [], [], 0
        if n:
            yield packed(ids, rows)
    return run


def _chunks(batches, dims: int, block: int):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("ids")[i].values, Chunk(batch.column("subvectors")[i].as_py(), batch.column("codes")[i].as_py(), dims, block)


def _gather(centroids: np.ndarray, block: int):
    """Per task and cluster: vectors, sum of their distances, componentwise sums."""
    def run(batches):
        k, dims = centroids.shape
        count, far, sums = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        for _, chunk in _chunks(batches, dims, block):
            cluster, distance = chunk.nearest(centroids)
            count += np.bincount(cluster, minlength=k)
            sums += chunk.sums(cluster, k)
            for c in range(k):
                d = distance[cluster == c]  # summed in halves, so that none passes a long
                far[c] += (int((d >> 32).sum()) << 32) + int((d & 0xFFFFFFFF).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), pa.array(count), pa.array([x >> 31 for x in far], pa.int64()),
             pa.array([x & 0x7FFFFFFF for x in far], pa.int64()), pa.array(list(sums), pa.list_(pa.int64()))],
            ["cluster", "n", "high", "low", "sums"])
    return run


def _assign(centroids: np.ndarray, block: int, names: list[str], inertia: list[int | None], whole: int | None):
    def run(batches):
        for ids, chunk in _chunks(batches, centroids.shape[1], block):
            cluster, distance = chunk.nearest(centroids)
            per = pa.array(inertia, pa.int64()).take(pa.array(cluster))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster.astype(np.int32)), pa.array(distance), per, pa.array([whole] * len(ids), pa.int64()),
                 pa.array(names, pa.string()).take(pa.array(cluster))],
                ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
    return run


def _round(packed: DataFrame, centroids: np.ndarray, block: int) -> list[tuple[int, int, list[int]]]:
    """Per cluster: vectors, sum of distances, componentwise sums, as exact integers."""
    dims = centroids.shape[1]
    parts = packed.mapInArrow(_gather(centroids, block), "cluster int, n long, high long, low long, sums array<long>")
    total = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(20,0)")).alias("high"), F.sum("low").alias("low"),
        *[F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)])
    rows = {r["cluster"]: r for r in total.collect()}
    return [(r["n"], (int(r["high"]) << 31) + int(r["low"]), [int(r[f"s{i}"]) for i in range(dims)])
            for r in (rows[c] for c in range(len(centroids)))]


def _long(x: int) -> int | None:
    return x if x < 2**63 else None


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS,
                      clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED,
                      block: int = BLOCK) -> DataFrame:
    """Per kept vector: its id, cluster, distance (squared), cluster_inertia and inertia (distance
    summed over its cluster and over all), centroid_sha256 (of its final centroid's components as
    decimal integers joined by commas). First centroids: the vectors with the smallest SHA-256 of
    ``seed:id``; then ``rounds`` of assignment and floor(sum / count), and a last assignment."""
    if min(dims, clusters, scale, block) < 1 or rounds < 0:
        raise ValueError("dims, clusters, scale and block must be positive, rounds not negative")
    v = pick(vectors, id=id_col, vector=vector_col).withColumn("vector", F.col("vector").cast("array<double>"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter((F.size("vector") == dims) & ~bad)
    kind = v.schema["id"].dataType.simpleString()
    packed = v.mapInArrow(_pack(dims, scale, block), f"ids array<{kind}>, subvectors array<binary>, codes array<binary>")
    packed = pinned(packed, "packed")

    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = v.select("vector", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "vector").limit(clusters).collect()
    out = "id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".format(kind)
    if not first:
        return vectors.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    centroids = integers(np.array([r["vector"] for r in first], float), scale)
    for _ in range(rounds):
        rows = _round(packed, centroids, block)
        centroids = np.array([[s // n for s in sums] if n else list(old) for (n, _, sums), old in zip(rows, centroids)], np.int64)
    far = [d for _, d, _ in _round(packed, centroids, block)]
    names = [sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    found = packed.mapInArrow(_assign(centroids, block, names, [_long(x) for x in far], _long(sum(far))), out)
    return found.withColumnRenamed("id", id_col)


def q_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(read(spark, sf_dir, "embeddings"))


QUERIES = {"op11_centroid_clusters": q_centroid_clusters}


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> str:
    """The rounds written out one after the other; c{r}: centroid number and components."""
    near = """a{r} AS (SELECT vec_id, v, arg_min(k, (d, k)) AS cluster, min(d) AS distance FROM (
  SELECT q.vec_id, q.v, c.k, list_sum(list_transform(range(1, %d), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))::BIGINT AS d
  FROM q, c{r} c) GROUP BY vec_id, v),
""" % (dims + 1)
    mean = """s{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (
  SELECT cluster, unnest(v) AS x, unnest(range(1, %d)) AS i FROM a{r}) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list(((s - ((s %% n) + n) %% n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY cluster),
c{n} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.k),
""" % (dims + 1)
    steps = "".join(near.format(r=r) + mean.format(r=r, n=r + 1) for r in range(rounds)) + near.format(r=rounds)
    return f"""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id))) - 1 AS k, v FROM q ORDER BY k LIMIT {clusters}),
{steps}e AS (SELECT cluster, sum(distance) AS d FROM a{rounds} GROUP BY cluster)
SELECT a.vec_id, a.cluster::INT AS cluster, a.distance, e.d::BIGINT AS cluster_inertia, (SELECT sum(d) FROM e)::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN e ON e.cluster = a.cluster JOIN c{rounds} c ON c.k = a.cluster"""


ORACLE = {"op11_centroid_clusters": _oracle()}

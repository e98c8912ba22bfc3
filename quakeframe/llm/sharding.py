"""Sharding by Karmarkar-Karp differencing: byte balance for groups that must stay whole.

A group is all documents with equal text; its bytes are one indivisible weight. Differencing
keeps a heap of partial partitions (``shards`` partial sums each), takes the two with the
largest spread and combines them in opposite order, until one is left. Done for all groups at
once that is a sequential job, so it runs as a tree: hash leaves of about ``LEAF`` groups are
differenced in parallel, then ``FANOUT`` of the resulting partial partitions are combined by
the same step, level by level, until one node remains. Each task holds at most a leaf or
FANOUT * shards sums. The choice of every node is joined back down the tree, and the documents
find their group's shard by text hash. Group sums combine before the shuffle, so a text with a
third of all rows is one weight and, on the way back, a join that AQE can split.

``slot`` numbers a shard's rows from 0 without gaps: rows are numbered inside (shard, piece),
and pieces (hash leaves of doc_id) get offsets from a small table of counts.

Edge cases: a null text has no bytes, crc 0 and size 1, apart from the empty text's group; an
empty table gives an empty result; repeated rows share a group and get slots of their own; a
null doc_id is placed like any other row; a very long text is one weight, its bytes plus 1; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import pick, pinned, read

SHARDS = 16
LEAF = 4096
FANOUT = 512


def difference(parts: list[list[int]], shards: int) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions (``shards`` sums each). Returns the sums of the result and,
    for each input, the final shard of each of its sums."""
    n = len(parts)
    sums: list = [None] * (2 * n)
    child: list = [None] * (2 * n)
    heap = []
    for i, p in enumerate(parts):
        sums[i] = p
        heap.append((min(p) - max(p), i))
    heapq.heapify(heap)
    nxt = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        down = sorted(range(shards), key=lambda s: (-sums[a][s], s))
        up = sorted(range(shards), key=lambda s: (sums[b][s], s))
        total = [sums[a][x] + sums[b][y] for x, y in zip(down, up)]
        to_a, to_b = [0] * shards, [0] * shards
        for s, (x, y) in enumerate(zip(down, up)):
            to_a[x], to_b[y] = s, s
        sums[nxt], child[nxt] = total, (a, to_a, b, to_b)
        heapq.heappush(heap, (min(total) - max(total), nxt))
        nxt += 1
    place = [None] * nxt
    place[nxt - 1] = list(range(shards))
    for i in range(nxt - 1, n - 1, -1):
        a, to_a, b, to_b = child[i]
        place[a] = [place[i][s] for s in to_a]
        place[b] = [place[i][s] for s in to_b]
    return sums[nxt - 1], place[:n]


def _leaf(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "h", "l"], ascending=False)
        parts = [[int(w)] + [0] * (shards - 1) for w in pdf["weight"]]
        sums, place = difference(parts, shards)
        out = pdf[["h", "l", "node"]].assign(part=[p[0] for p in place])
        out["total"] = [sums[p] for p in out["part"]]
        return out[["h", "l", "node", "part", "total"]]
    return run


def _node(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = pdf["parent"].iloc[0]
        nodes = sorted(set(pdf["node"]))
        at = {v: i for i, v in enumerate(nodes)}
        parts = [[0] * shards for _ in nodes]
        for node, part, total in zip(pdf["node"], pdf["part"], pdf["total"]):
            parts[at[node]][part] = int(total)
        sums, place = difference(parts, shards)
        rows = [(node, s, parent, place[at[node]][s], sums[place[at[node]][s]]) for node in nodes for s in range(shards)]
        return pd.DataFrame(rows, columns=["node", "part", "parent", "up", "total"])
    return run


def balance(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``groups``: h, l (the group's key), weight. Returns h, l, shard."""
    leaves = max(1, -(-groups.count() // LEAF))
    level = groups.withColumn("node", F.pmod(F.xxhash64("h", "l"), F.lit(leaves)))
    placed = pinned(level.groupBy("node").applyInPandas(
        _leaf(shards), "h long, l long, node long, part int, total long"), "leaves")
    tops = placed.select("node", "part", "total").distinct()
    nodes = leaves
    while nodes > 1:
        up = tops.withColumn("parent", F.col("node") % -(-nodes // FANOUT))
        up = pinned(up.groupBy("parent").applyInPandas(
            _node(shards), "node long, part int, parent long, up int, total long"), "nodes")
        step = up.select("node", "part", "parent", "up")
        placed = placed.select("h", "l", "node", "part").join(step, ["node", "part"]).select(
            "h", "l", F.col("parent").alias("node"), F.col("up").alias("part"))
        tops = up.select(F.col("parent").alias("node"), F.col("up").alias("part"), "total").distinct()
        nodes = -(-nodes // FANOUT)
    return placed.select("h", "l", F.col("part").alias("shard"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per document row: doc_id, size, text_crc32, shard, slot."""
    d = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).alias("text_crc32"),
        # Two texts with one key would only share a shard, never be torn.
        F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long").alias("l"))
    d = pinned(d, "sizes")
    groups = d.groupBy("h", "l").agg(F.sum("size").alias("weight"))
    out = d.join(balance(groups, shards), ["h", "l"])
    pieces = max(1, d.count() // 200_000)
    out = pinned(out.withColumn("piece", F.pmod(F.xxhash64("doc_id", "h", "l"), F.lit(pieces))), "placed")
    counts = out.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard", "piece").orderBy("doc_id", "h", "l")
    out = out.withColumn("k", F.row_number().over(inside) - 1).join(counts, ["shard", "piece"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("k")).alias("slot"))


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_sharding": q_sharding}

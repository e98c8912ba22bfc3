"""Connected components of an edge table by repeated contraction (DataFrame functions only).

Each round every node points to the smallest node among itself and its neighbours, and the
edges are rewritten to the nodes pointed to; edges inside one node vanish. Node keys are
hashes, so their order is random and the number of nodes falls by a constant factor a round
whatever the shape. All sums and minima combine on the map side; no neighbourhood is ever
collected, so a node with any number of edges is only many rows. Each round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import pinned


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b. Returns node, root: one row per node that has an edge."""
    edges = pinned(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    none = edges.limit(0).select(F.col("a").alias("node"), F.col("b").alias("root"))
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        # One pointer jump: node -> up -> up's up.
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = pinned(up.join(jump, "up").select("node", F.col("top").alias("root")), "up")
        steps.append(up)
        a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = pinned(edges.join(a, "a").join(b, "b").filter("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not steps:
        return none
    labels = steps[0]  # every node is in the first step, what is left of them in the later ones
    for up in steps[1:]:
        step = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return pinned(labels, "labels")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``roots`` (node, root) after more links (a, b): only the graph between
    the known components is contracted."""
    at = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    edges = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = components(edges)
    step = more.select(F.col("node").alias("root"), F.col("root").alias("next"))
    old = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    new = more.join(roots.select("node"), "node", "left_anti")
    return pinned(old.unionByName(new), "labels")

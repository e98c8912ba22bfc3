"""Merkle manifest of a data set, with proofs that resume copied SHA-256 states.

A leaf is the SHA-256 (lowercase hex) of a row's fields, each as UTF-8 byte count, ``:``, value,
or ``-`` if null. Leaves of a group stand in the order of the id; every ``FANOUT`` consecutive
nodes become the SHA-256 of their hex digests joined, until one node remains, the group's subroot;
the subroots, in the order of the group key (null first), likewise become the root.

Only digests are shuffled. Positions come from a range partition (no group lies in one task),
and nodes are cut into blocks of FANOUT ** LEVELS = 4096. A task sees a block at a time:

* upwards, blocks become the nodes of the next stage, until each group has one (one pass over
  the leaves, one over a 4096th of them, and so on); the same for the subroots of all groups;
* downwards, each block is given its path (the siblings left and right of it on every level up
  to the root). A parent keeps a copy of its hash state before each child slot, for the parents
  above the block too, where the state is that of all left siblings. Folding another leaf to
  the root resumes the state before its slot on each level and takes in only the replacement and
  the siblings to the right; the left ones are never read again.

A block and its path are bounded, whatever the size of groups, whether one group holds all
rows or each row is a group of its own. Nothing is broadcast or collected; each stage is a
table in the shared folder.

Edge cases: null values are ``-`` (an empty text is ``0:``); a null group key is a group of its
own, the first; null ids come first; rows that share an id are ordered by their leaves, rows
equal in all fields have equal leaves in any order (each keeps its own place and proof); very
long texts are hashed whole where they are read; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import ascii_lower, pinned, read, ship
from quakeframe.operators.ranking import group_positions

FANOUT = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:binary,right:binary>>"
_PATH_ARROW = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def leaf(values: list[Column]) -> Column:
    """Digest of one row: its values as text, each with its byte count; null is ``-``."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
             for v in values]
    return F.sha2(F.concat(*parts), 256)


class Level:
    """The parents over consecutive nodes: digests, and the hash state before every child slot."""

    def __init__(self, nodes: list[bytes]):
        self.nodes, self.states, self.parents = nodes, [], []
        for i in range(0, len(nodes), FANOUT):
            h = sha256()
            for child in nodes[i: i + FANOUT]:
                self.states.append(h.copy())
                h.update(child)
            self.parents.append(h.hexdigest().encode())
        self.right = [b"".join(nodes[i + 1: i - i % FANOUT + FANOUT]) for i in range(len(nodes))]

    def left(self, at: int) -> bytes:
        return b"".join(self.nodes[at - at % FANOUT: at])


class Above:
    """A parent above the block: the state after its left siblings, and its right ones."""

    def __init__(self, left: bytes, right: bytes):
        self.state, self.right, self.siblings = sha256(left), right, left + right


def fold(state, replacement: bytes, right: bytes) -> bytes:
    """Digest of a parent with another child: the copied state goes on from its slot."""
    h = state.copy()
    h.update(replacement)
    h.update(right)
    return h.hexdigest().encode()


def _levels(nodes: list[bytes], size: int, depth: int) -> list[Level]:
    """The levels inside one block of a group of ``size`` nodes: ``depth`` of them, or as many as
    leave one node if the block is the whole group."""
    out = []
    while len(out) < depth if size > FANOUT**depth else len(nodes) > 1:
        out.append(Level(nodes))
        nodes = out[-1].parents
    return out


def _blocks(batches):
    """The blocks of sorted batches: a block begins at each row whose ``first`` is true."""
    have: list[pa.RecordBatch] = []
    for batch in batches:
        cuts = [*pc.indices_nonzero(batch.column("first")).to_pylist(), batch.num_rows]
        if cuts[0] > 0:
            have.append(batch.slice(0, cuts[0]))
        for i, j in zip(cuts, cuts[1:]):
            if have:
                yield pa.Table.from_batches(have)
            have = [batch.slice(i, j - i)]
    if have:
        yield pa.Table.from_batches(have)


def _digests(column: pa.ChunkedArray) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _paths(t: pa.Table, depth: int):
    """Of a block that begins with the row of its path: the levels inside it, and those above."""
    nodes = _digests(t.column("digest").slice(1))
    levels = _levels(nodes, t.column("size")[1].as_py(), depth)
    return nodes, levels, [(x["left"], x["right"]) for x in t.column("path")[0].as_py()]


class _Run:
    """The functions that tasks run over the blocks of their rows."""

    def __init__(self):
        self.depth = LEVELS

    def up(self, batches):
        for t in _blocks(batches):
            nodes = _digests(t.column("digest"))
            pos, size = t.column("pos")[0].as_py(), t.column("size")[0].as_py()
            levels = _levels(nodes, size, self.depth)
            top = levels[-1].parents[0] if levels else nodes[0]
            block = FANOUT**self.depth
            yield pa.RecordBatch.from_arrays(
                [t.column("grp").slice(0, 1).combine_chunks(), pa.array([pos // block]), pa.array([-(-size // block)]),
                 pa.array([top.decode()])], ["grp", "pos", "size", "digest"])

    def down(self, batches):
        for t in _blocks(batches):
            nodes, levels, above = _paths(t, self.depth)
            paths = []
            for i in range(len(nodes)):
                own, at = [], i
                for level in levels:
                    own.append({"left": level.left(at), "right": level.right[at]})
                    at //= FANOUT
                paths.append(own + [{"left": a, "right": b} for a, b in above])
            rest, n = t.slice(1), len(nodes)
            yield pa.RecordBatch.from_arrays(
                [rest.column("grp").combine_chunks(), rest.column("pos").combine_chunks(), pa.array(paths, _PATH_ARROW),
                 *[pa.array([t.column(c)[0].as_py()] * n, pa.string()) for c in ("subroot", "root")]],
                ["grp", "pos", "path", "subroot", "root"])

    def folds(self, batches):
        for t in _blocks(batches):
            nodes, levels, above = _paths(t, self.depth)
            tops = [Above(a, b) for a, b in above]
            rest = t.slice(1)
            proofs, folded = [], []
            for i, other in enumerate(_digests(rest.column("other"))):
                proof, at = sha256(), i
                for level in levels:
                    proof.update(level.left(at) + level.right[at])
                    other = fold(level.states[at], other, level.right[at])
                    at //= FANOUT
                for top in tops:
                    proof.update(top.siblings)
                    other = fold(top.state, other, top.right)
                proofs.append(proof.hexdigest())
                folded.append(other.decode())
            n, root = len(nodes), t.column("root")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [rest.column("id").combine_chunks(), rest.column("digest").combine_chunks(),
                 pa.array([t.column("subroot")[0].as_py()] * n, pa.string()), pa.array([root] * n, pa.string()),
                 pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([x == root for x in folded], pa.bool_())],
                ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _in_blocks(nodes: DataFrame, first: Column, *then: Column) -> DataFrame:
    """Rows of a block side by side and in order, each block in one partition."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**LEVELS)).withColumn("first", first)
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", *then, "pos")


def _stages(nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` (grp, pos, size, digest) and the stages above them; the last has one node a group."""
    kind = nodes.schema["grp"].dataType.simpleString()
    out = [nodes]
    while not out or len(out) == 1 or not out[-1].filter("size > 1").isEmpty():
        rows = _in_blocks(out[-1].select("grp", "pos", "size", "digest"), F.col("pos") % FANOUT**LEVELS == 0)
        out.append(pinned(rows.mapInArrow(_Run().up, f"grp {kind}, pos long, size long, digest string"), name))
    return out


def _with_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks that begin with the row of their path (grp, pos of the block, path, subroot, root)."""
    heads = paths.withColumn("pos", F.col("pos") * FANOUT**LEVELS)
    rows = nodes.unionByName(heads, allowMissingColumns=True)
    return _in_blocks(rows, F.col("path").isNotNull(), F.col("path").isNull())


def _paths_to(stages: list[DataFrame], paths: DataFrame, name: str) -> DataFrame:
    """The paths of the blocks of the lowest stage, from those of the single nodes on top."""
    kind = stages[0].schema["grp"].dataType.simpleString()
    for nodes in reversed(stages[1:-1]):
        rows = _with_paths(nodes.select("grp", "pos", "size", "digest"), paths)
        paths = pinned(rows.mapInArrow(_Run().down, f"grp {kind}, pos long, path {_PATH}, subroot string, root string"), name)
    return paths


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS,
             changed: dict[str, Column] | None = None) -> DataFrame:
    """Per row: its id (under its own name), leaf, subroot, root, proof_sha256 (digest of its
    siblings from the leaf to the root, left to right), folded_root (the root that the leaf of
    the ``changed`` fields gives with the original siblings) and verified (whether that is the
    root). ``changed`` has the new value of a field as an expression over the input."""
    ship(docs.sparkSession)
    new = changed or {}
    own = [docs[c] for c in fields]
    digest = leaf(own)
    other = leaf([new.get(c, v) for c, v in zip(fields, own)]) if new else digest
    same = F.lit(True)
    for c, v in new.items():
        same = same & v.eqNullSafe(docs[c])
    rows = docs.select(docs[id_col].alias("id"), docs[group_col].alias("grp"), digest.alias("digest"),
                       F.when(same, F.lit(None)).otherwise(other).alias("other"))
    rows = rows.withColumn("other", F.coalesce("other", "digest"))
    leaves = pinned(group_positions(rows, ["grp"], ["id", "digest"], size_col="size", pos_type="long"), "leaves")
    trees = _stages(leaves, "nodes")

    # The subroots are the leaves of one more tree.
    subs = trees[-1].select("grp", F.lit(0).alias("all"), F.col("digest").alias("subroot"))
    subs = pinned(group_positions(subs, ["all"], ["grp"], size_col="size", pos_type="long"), "subroots")
    tops = _stages(subs.select(F.col("all").alias("grp"), "pos", "size", F.col("subroot").alias("digest")), "top")
    none = F.lit(None).cast("string")
    path = F.array().cast(_PATH)
    root = tops[-1].select("grp", "pos", path.alias("path"), none.alias("subroot"), F.col("digest").alias("root"))
    root = _paths_to(tops, root, "top-paths")
    rows = _with_paths(tops[0], root)
    path = pinned(rows.mapInArrow(_Run().down, f"grp int, pos long, path {_PATH}, subroot string, root string"), "group-paths")
    named = subs.select("grp", "subroot", "pos").join(path.select("pos", "path", "root"), "pos")
    paths = _paths_to(trees, named.select("grp", F.lit(0).cast("long").alias("pos"), "path", "subroot", "root"), "paths")

    kind = leaves.schema["id"].dataType.simpleString()
    out = _with_paths(leaves.select("grp", "pos", "size", "digest", "id", "other"), paths).mapInArrow(
        _Run().folds, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)


def q_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    return manifest(docs, changed={"text": F.when(tampered, ascii_lower(docs["text"])).otherwise(docs["text"])})


QUERIES = {"op13_merkle_manifest": q_merkle_manifest}

_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen({0}::VARCHAR), ':', {0}::VARCHAR) END"
_FOUR = ", ".join(_PART.format(c) for c in FIELDS[:4])
ORACLE = {"op13_merkle_manifest": f"""
WITH RECURSIVE t AS (
  SELECT *, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))) AS crc,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
h AS (SELECT doc_id, lang, sha256(concat({_FOUR}, {_PART.format("text")})) AS leaf,
  CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(concat({_FOUR}, {_PART.format("low")})) END AS low FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM h),
lv(lang, level, d) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM p GROUP BY lang UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(d), 8), lambda i: sha256(array_to_string(d[i + 1 : i + 8], ''))) FROM lv WHERE len(d) > 1),
sub AS (SELECT lang, level AS top, d[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM lv WHERE len(d) = 1),
tv(level, d) AS (
  SELECT 0, list(subroot ORDER BY place) FROM sub UNION ALL
  SELECT level + 1, list_transform(range(0, len(d), 8), lambda i: sha256(array_to_string(d[i + 1 : i + 8], ''))) FROM tv WHERE len(d) > 1),
st AS (
  SELECT lang, level AS step, d, NULL::BIGINT AS place FROM lv WHERE len(d) > 1 UNION ALL
  SELECT lang, top + level, d, CASE WHEN level = 0 THEN place END FROM sub, tv WHERE len(d) > 1),
f(leaf, doc_id, lang, step, pos, cur, proof) AS (
  SELECT leaf, doc_id, lang, 0, pos, coalesce(low, leaf), '' FROM p UNION ALL
  SELECT leaf, doc_id, lang, step + 1, a // 8, sha256(concat(l, cur, r)), concat(proof, l, r) FROM (
    SELECT f.*, coalesce(st.place, f.pos) AS a, array_to_string(d[a // 8 * 8 + 1 : a], '') AS l, array_to_string(d[a + 2 : a // 8 * 8 + 8], '') AS r
    FROM f JOIN st ON f.step = st.step AND f.lang IS NOT DISTINCT FROM st.lang))
SELECT doc_id, leaf, subroot, (SELECT d[1] FROM tv WHERE len(d) = 1) AS root, sha256(proof) AS proof_sha256, cur AS folded_root,
  cur = (SELECT d[1] FROM tv WHERE len(d) = 1) AS verified
FROM f JOIN sub ON f.lang IS NOT DISTINCT FROM sub.lang
WHERE f.step = (SELECT max(step) + 1 FROM st WHERE st.lang IS NOT DISTINCT FROM f.lang)"""}

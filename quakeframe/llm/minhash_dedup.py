"""Near-duplicate groups by an inverted join over MinHash coordinates.

1. Per document: the set of 5-word shingle hashes and a signature of ``COORDS`` minima (numpy,
   whole texts). Documents with equal sets form one class at once; copies are never paired.
2. Post each class under its (coordinate, value) tokens and count the posting lists. Two texts
   with similarity s agree in a coordinate with chance s, so linked texts (s >= 0.85) share at
   least ``MATCHES`` = 16 of 32 tokens but for a chance below 1e-6. With that bound a class
   need be posted only under its COORDS - MATCHES + 1 rarest tokens (prefix); the MATCHES - 1
   longest lists, those of boilerplate, are skipped.
3. In each remaining list, compare every class to the list's smallest (a star: as many pairs
   as postings), count collisions on the signatures, keep pairs with MATCHES or more, confirm
   on the full shingle sets, and take connected components.
4. What is left: pairs of one list in different components that were not compared yet. They
   are compared likewise, so no link between two components is lost, while members of a large
   group that already hangs together are not paired with one another, nor are copies whose
   rare shingles rule a link out. Before that, a second star around the most typical class of
   each list joins most of what the first centre, a copy with edits of its own, did not.

Signatures carry a recall bound of 1 - 1e-6 per link; a confirmed link is exact (on 64-bit
shingle hashes). No list is capped; nothing is broadcast or collected.

Edge cases: null, empty or wordless text has no shingles, is linked with nothing and is its
own component; fewer than five words are one shingle; rows with equal sets, repeated rows
included, are linked; a null doc_id is never the smallest, unless a component has no other; very
long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quakeframe.llm.common import pick, pinned, read
from quakeframe.llm.components import components, merged
from quakeframe.llm.textwords import Words, chunks, mix

SHINGLE = 5
COORDS = 32
MATCHES = 16
RARE = 8  # a shingle of at most so many of the open classes is rare
_BLOCK = 1 << 14  # shingles per block of the signature matrix


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (2, n, 1), dtype=np.uint64)
    return both[0], both[1] | np.uint64(1)


def shingle_sets(w: Words, rows: int, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a chunk."""
    full = w.windows(k)
    out = []
    for r in range(rows):
        a, b = int(w.first[r]), int(w.first[r + 1])
        if b - a >= k:
            out.append(np.unique(full[a: b - k + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for x in w.hash[a:b]:
                h = mix(np.array([h], np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ x)[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """Tokens coordinate << 32 | upper half of the coordinate's minimum, as int64."""
    low = None
    for i in range(0, len(s), _BLOCK):
        m = ((s[None, i: i + _BLOCK] ^ xor) * mul).min(axis=1)
        low = m if low is None else np.minimum(low, m)
    return ((np.arange(len(low), dtype=np.uint64) << np.uint64(32)) | (low >> np.uint64(32))).view(np.int64)


def _set_key(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        one, two = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return (int(one).to_bytes(8, "little") + (int(two) ^ len(s)).to_bytes(8, "little"))


def _signed(k: int, coords: int):
    def run(batches):
        xor, mul = _seeds(coords)
        for batch in batches:
            n, keys, sigs = [], [], []
            for i, j, data, offs in chunks(batch.column("text")):
                for s in shingle_sets(Words(data, offs, lower=True), j - i, k):
                    n.append(len(s))
                    keys.append(_set_key(s) if len(s) else None)
                    sigs.append(signature(s, xor, mul) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "th", "n_shingles", "key", "sig"])
    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            keys = batch.column("key")
            for i, j, data, offs in chunks(batch.column("text")):
                sets = [s.view(np.int64) for s in shingle_sets(Words(data, offs, lower=True), j - i, k)]
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array(sets, pa.list_(pa.int64()))], ["key", "set"])
    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
               coords: int = COORDS) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, key (of the set; null without words), sig."""
    d = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_signed(k, coords), f"doc_id {kind}, th long, n_shingles long, key binary, sig array<long>")


def prefix_postings(classes: DataFrame, coords: int, matches: int) -> DataFrame:
    """token, key: each class under the rarest coords - matches + 1 of its tokens, of those
    that another class has too."""
    posts = classes.select("key", F.explode("sig").alias("token"))
    shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    posts = posts.join(shared, "token")
    per_class = Window.partitionBy("key")  # at most `coords` rows
    posts = posts.withColumn("have", F.count(F.lit(1)).over(per_class)).withColumn(
        "rank", F.row_number().over(per_class.orderBy("n", "token")))
    # Tokens of no one else are the rarest of all and come first.
    return posts.filter(F.col("rank") + (coords - F.col("have")) <= coords - matches + 1).select("token", "key")


def _linked(similarity: float, a: Column, b: Column) -> Column:
    same = F.size(F.array_intersect(a, b))
    return 100 * same >= round(100 * similarity) * (F.size(a) + F.size(b) - same)


def _mixed(posts: DataFrame) -> DataFrame:
    """The postings of tokens that more than one component has."""
    roots = posts.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return posts.join(roots.filter("lo <> hi").select("token"), "token", "left_semi")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (with key) and the component of each key; a key without links is its own."""
    return rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def _rare_shingles(held: DataFrame) -> DataFrame:
    """s, n, key: the shingles that at most RARE of the classes have."""
    parts = held.select("key", F.explode("set").alias("s"))
    few = parts.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= RARE)
    return parts.join(few, "s")


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _open_pairs(posts: DataFrame, rare: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of different components that may still be linked.

    Two classes either share a rare shingle, and meet under it (at most RARE classes do), or
    have none of their rare shingles in common: then with r rare ones of n, the intersection is
    at most ``most`` = n - r of either, and a pair is needed only if the smaller ``most`` is at
    least similarity * (n + n' - most). Copies that differ from a common text by edits of their
    own are not paired with one another, however many there are."""
    percent = round(100 * similarity)
    posts = _mixed(posts.join(facts.filter(100 * F.col("most") >= percent * F.col("n")), "key"))
    # Under each token all but its largest component meet the whole token: members of a large
    # component are not even compared among themselves.
    main = posts.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(
        F.max(F.struct("c", "root")).alias("m")).select("token", F.col("m.root").alias("main"))
    posts = pinned(posts.join(main, "token"), "mixed")
    x, y = posts.filter("root <> main").alias("x"), posts.alias("y")
    both = F.least("x.most", "y.most")
    close = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root"))
                   & ((F.col("y.root") == F.col("y.main")) | (F.col("x.key") < F.col("y.key")))
                   & (100 * both >= percent * (F.col("x.n") + F.col("y.n") - both)))
    x, y = rare.alias("x"), rare.alias("y")
    akin = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root")))
    return close.select(*_pairs("x.key", "y.key")).unionByName(akin.select(*_pairs("x.key", "y.key"))).distinct()


def _confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame, matches: int, similarity: float) -> DataFrame:
    """Of (a, b): those with enough equal coordinates and, on full sets, enough similarity."""
    for x in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("key").alias(x), F.col("sig").alias(f"sig_{x}")), x)
    pairs = pairs.filter(F.size(F.array_intersect("sig_a", "sig_b")) >= matches).select("a", "b")
    for x in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("key").alias(x), F.col("set").alias(f"set_{x}")), x)
    return pairs.filter(_linked(similarity, F.col("set_a"), F.col("set_b"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.85,
                    k: int = SHINGLE, coords: int = COORDS, matches: int = MATCHES) -> DataFrame:
    """Per document row: doc_id, th (hash of the text), n_shingles, component_id (smallest doc_id
    reachable over links of at least ``similarity``, its own included), kept (is that doc_id), and
    first: whether the row, by id and text, is the first of its component."""
    signed = pinned(signatures(docs, id_col, text_col, k, coords), "signatures")
    classes = signed.filter("key is not null").groupBy("key").agg(
        F.first("sig").alias("sig"), F.min(F.struct("doc_id", "th")).alias("rep"))
    posts = pinned(prefix_postings(classes, coords, matches), "postings")
    d = pick(docs, doc_id=id_col, text=text_col).select("doc_id", "text", F.xxhash64("text").alias("th"))
    posted = classes.join(posts.select("key").distinct(), "key", "left_semi")
    reps = posted.select("key", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"))
    texts = d.join(reps, (d["th"] == reps["rep_th"]) & d["doc_id"].eqNullSafe(reps["rep_id"])).select("key", "text")
    # Equal rows (same id and text) meet the class twice; one set of them is enough.
    sets = pinned(texts.mapInArrow(_sets(k), "key binary, set array<long>").dropDuplicates(["key"]), "sets")
    few = pinned(posted.select("key", "sig"), "classes")

    heads = posts.groupBy("token").agg(F.min("key").alias("a"))
    star = posts.join(heads, "token").filter("a <> key").select("a", F.col("key").alias("b")).distinct()
    star = pinned(star, "star")
    roots = components(_confirm(star, few, sets, matches, similarity))

    # What is left: tokens that several components have.
    left = pinned(_mixed(_with_roots(posts, roots)), "mixed")
    held = sets.join(left.select("key").distinct(), "key", "left_semi")
    rare = pinned(_rare_shingles(held), "rare")
    own = rare.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("r"))
    facts = pinned(held.select("key", F.size("set").alias("n")).join(own, "key", "left").select(
        "key", "n", (F.col("n") - F.coalesce("r", F.lit(0))).alias("most")), "facts")
    # A second star around the class with the fewest rare shingles: the most typical copy.
    ranked = left.join(facts, "key").withColumn("odd", F.col("n") - F.col("most"))
    heads = ranked.groupBy("token").agg(F.min(F.struct("odd", "key", "root")).alias("c"))
    again = left.join(heads, "token").filter(F.col("c.root") != F.col("root"))
    again = again.select(*_pairs("c.key", "key")).distinct().join(star, ["a", "b"], "left_anti")
    star = pinned(star.unionByName(again), "star")
    roots = merged(roots, _confirm(again, few, sets, matches, similarity))

    rest = _open_pairs(_mixed(_with_roots(left.drop("root"), roots)), _with_roots(rare.filter("n > 1"), roots), facts, similarity)
    roots = merged(roots, _confirm(rest.join(star, ["a", "b"], "left_anti"), few, sets, matches, similarity))

    roots = roots.withColumnRenamed("node", "key")
    labelled = signed.select("doc_id", "th", "n_shingles", "key").join(roots, "key", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "key"))
    # The smallest row of a component by id, then text; rows without id come last.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    least = signed.filter("key is not null").groupBy("key").agg(F.min(row).alias("least")).join(roots, "key", "left")
    least = least.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("least").alias("least"))
    out = labelled.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"),
                      (F.col("root").isNull() | (row.eqNullSafe(F.col("least")))).alias("first"))


def q_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("th", "first")


QUERIES = {"op5_minhash_dedup": q_minhash_dedup}

ORACLE = {"op5_minhash_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(sh) AS h FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e2.b FROM r JOIN e2 ON r.seen = e2.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id"""}

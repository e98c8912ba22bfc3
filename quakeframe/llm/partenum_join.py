"""N-gram Jaccard join by PartEnum signatures.

1. A document is the set of its 3-word shingles (64-bit hashes). Documents with equal sets form
   one class at once, named by its first row's number; copies are never paired.
2. Sizes are cut into bands whose edges grow by (100 / percent) squared. In a band with upper
   edge r, sets of similarity percent / 100 differ in at most k = 2 r (100 - percent) /
   (100 + percent) features. The feature domain is hashed into enough first partitions that in
   one of them at most ``DIFFER`` features differ, and each of those into ``DIFFER + 2`` second
   ones: whatever differs, some subset of ``2`` of these is equal on both sides. Every class
   posts one signature (a hash of the projected set) per first partition and subset, in its own
   band, and in the next one if a partner may lie there. So every linked pair shares a signature:
   no link is missed, and nothing is capped.
3. Postings of signatures that two classes share are kept: one shuffle of (signature, ref).
   Candidates must pass two exact bounds, on the sizes and on a parity sketch (bit i: whether an
   odd number of features hash to i; unequal bits never outnumber unequal features). What is
   left is confirmed on the full sets.
4. ``linked_classes`` pairs the classes of each signature and returns all links. ``components``
   of a join do not need them: ``similar_documents`` first compares each class with one of its
   list (a star, as many pairs as postings), joins the components, then stars again around the
   class with the most shared signatures, and at last compares only classes that still lie in
   different components, so that large groups of copies are not paired among themselves.

A signature is part of a document's sets, some 40 for 300 words, so even where copies of one
text are a third of all rows, one signature holds under a hundredth of the postings; the window
that finds shared ones spills, and joins split such keys (AQE). Everything bounded by a
document stays in a row; nothing is broadcast or collected.

Edge cases: null, empty or wordless texts have no shingles, are linked with nothing and are
their own component; fewer than three words are one shingle; rows with equal sets, repeated rows
included, are linked; very long texts are read whole (their signatures grow with them); a null
doc_id is never the smallest unless a component has no other; empty tables give empty results;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quakeframe.llm.common import pick, pinned, read
from quakeframe.llm.components import components, merged
from quakeframe.llm.textwords import Words, chunks, mix

SHINGLE = 3
PERCENT = 90
DIFFER = 1  # features that may differ inside a first partition
SKETCH = 1024  # bits of the parity sketch

_U = np.uint64


def shingle_sets(w: Words, rows: int, k: int):
    """Sorted distinct shingle hashes of each row; a row of fewer words has one shingle."""
    whole = {n: w.windows(n) for n in range(1, k + 1)}
    for r in range(rows):
        a, b = int(w.first[r]), int(w.first[r + 1])
        n = min(k, b - a)
        yield np.unique(whole[n][a: b - n + 1]) if n else np.zeros(0, _U)


def band(n: int, percent: int) -> tuple[int, int]:
    """Number and upper edge of the size band of n."""
    i, high = 0, 1
    while high < n:
        i, high = i + 1, max(high + 1, (high + 1) * 10000 // percent**2)
    return i, high


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """The PartEnum signatures of one set, in its band and in those of its larger partners."""
    if not len(s):
        return np.zeros(0, _U)
    place = mix(s ^ _U(0xA5A5A5A5A5A5A5A5))
    first, last = band(len(s), percent), band(len(s) * 100 // percent, percent)
    tags = [first]
    while tags[-1][0] < last[0]:
        tags.append(band(tags[-1][1] + 1, percent))
    out = []
    for tag, high in tags:
        k = 2 * high * (100 - percent) // (100 + percent)
        d = min(DIFFER, k)
        outer, inner = -(-(k + 1) // (d + 1)), d + 2
        cell = (place >> _U(32)) % _U(outer) * _U(inner) + (place & _U(0xFFFFFFFF)) % _U(inner)
        sums = np.zeros(outer * inner, _U)
        np.add.at(sums, cell.astype(np.int64), s)
        sums = sums.reshape(outer, inner)
        for c, some in enumerate(combinations(range(inner), inner - d)):
            name = (np.arange(outer, dtype=_U) * _U(1024) + _U(c)) * _U(4096) + _U(tag)
            out.append(mix(sums[:, some].sum(axis=1, dtype=_U) ^ mix(name)))
    return np.concatenate(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the number of features at each of SKETCH places, as longs."""
    odd = np.bincount((mix(s ^ _U(0x5BD1E9955BD1E995)) % _U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _set_key(s: np.ndarray) -> bytes:
    one, two = mix(s).sum(dtype=_U), mix(s ^ _U(0xD1B54A32D192ED03)).sum(dtype=_U)
    return int(one).to_bytes(8, "little") + (int(two) ^ len(s)).to_bytes(8, "little")


def _over_sets(k: int, keep: tuple[str, ...], make):
    """A mapInArrow function: the columns of ``keep`` as they are, and what ``make`` says of each
    row's set (columns of equal length)."""
    def run(batches):
        for batch in batches:
            for i, j, data, offs in chunks(batch.column("text")):
                sets = list(shingle_sets(Words(data, offs, lower=True), j - i, k))
                made = make(sets)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in keep] + list(made.values()),
                                                 [*keep, *made])
    return run


def _facts(percent: int):
    def make(sets):
        longs = pa.list_(pa.int64())
        return {"n": pa.array([len(s) for s in sets], pa.int64()),
                "key": pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()),
                "bits": pa.array([sketch(s) for s in sets], longs),
                "sigs": pa.array([signatures(s, percent).view(np.int64) for s in sets], longs)}
    return make


def _arrays(sets):
    return {"set": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}


class _Join:
    """The shared first part of both results: rows, classes, shared postings, facts and sets."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int, k: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be above 0 and at most 100")
        self.percent = percent
        d = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")
        kind = d.schema["doc_id"].dataType.simpleString()
        rows = d.mapInArrow(_over_sets(k, ("doc_id", "th"), _facts(percent)),
                            f"doc_id {kind}, th long, n long, key binary, bits array<long>, sigs array<long>")
        # A row's number is fixed once the rows are written.
        self.rows = pinned(rows.withColumn("ref", F.monotonically_increasing_id()), "rows")
        classes = self.rows.filter("key is not null").groupBy("key").agg(F.min("ref").alias("class"))
        self.classes = pinned(classes, "classes")
        reps = self.rows.join(self.classes.select(F.col("class").alias("ref")), "ref", "left_semi")
        per_sig = Window.partitionBy("sig")
        posts = reps.select("ref", F.explode("sigs").alias("sig"))
        posts = posts.withColumn("head", F.min("ref").over(per_sig)).withColumn("last", F.max("ref").over(per_sig))
        self.posts = pinned(posts.filter("head <> last").drop("last"), "postings")
        some = self.rows.drop("key", "sigs").join(self.posts.select("ref").distinct(), "ref", "left_semi")
        self.facts = pinned(some, "facts")
        few = self.facts.select("ref", F.col("doc_id").alias("rep_id"), F.col("th").alias("rep_th"))
        texts = d.join(few, (d["th"] == few["rep_th"]) & d["doc_id"].eqNullSafe(few["rep_id"])).select("ref", "text")
        # Equal rows meet their class several times; one set of them is enough.
        sets = texts.mapInArrow(_over_sets(k, ("ref",), _arrays), "ref long, set array<long>")
        self.sets = pinned(sets.dropDuplicates(["ref"]), "sets")

    def possible(self, a: str, b: str) -> Column:
        """Whether sizes and sketches of two classes allow a link (never false for a link)."""
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        sizes = 100 * F.least(na, nb) >= self.percent * F.greatest(na, nb)
        apart = sum((F.bit_count(F.get(F.col(f"{a}.bits"), i).bitwiseXOR(F.get(F.col(f"{b}.bits"), i)))
                     for i in range(SKETCH // 64)), F.lit(0))
        return sizes & ((100 + self.percent) * apart <= (100 - self.percent) * (na + nb))

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that both bounds allow."""
        for x in ("a", "b"):
            pairs = pairs.join(self.facts.select(F.col("ref").alias(x), F.struct("n", "bits").alias(f"f{x}")), x)
        return pairs.filter(self.possible("fa", "fb")).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs: those whose full sets are similar enough, with the intersection."""
        for x in ("a", "b"):
            pairs = pairs.join(self.sets.select(F.col("ref").alias(x), F.col("set").alias(f"set_{x}")), x)
        same = F.size(F.array_intersect("set_a", "set_b"))
        pairs = pairs.select("a", "b", same.alias("same"), (F.size("set_a") + F.size("set_b")).alias("both"))
        return pairs.filter(100 * F.col("same") >= self.percent * (F.col("both") - F.col("same")))


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                   k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """The join itself. Returns membership (doc_id, n_shingles, class; class is null without
    words) and links: a, b (classes, a < b), n_same (shared shingles), all of similarity
    ``percent`` / 100 or more. Documents of one class have equal sets and are linked too."""
    j = _Join(docs, id_col, text_col, percent, k)
    held = j.posts.join(j.facts.select("ref", "n", "bits"), "ref")
    x, y = held.alias("x"), held.alias("y")
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.ref") < F.col("y.ref")) & j.possible("x", "y"))
    pairs = pairs.select(F.col("x.ref").alias("a"), F.col("y.ref").alias("b")).distinct()
    links = j.confirmed(pairs).select("a", "b", F.col("same").cast("long").alias("n_same"))
    members = j.rows.select("doc_id", F.col("n").alias("n_shingles"), "key").join(j.classes, "key", "left").drop("key")
    return members, links


def _mixed(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """The postings of signatures that more than one component still shares."""
    r = posts.drop("root").join(roots.select(F.col("node").alias("ref"), "root"), "ref", "left")
    r = r.withColumn("root", F.coalesce("root", "ref"))
    span = r.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    return r.join(span.select("sig"), "sig", "left_semi")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                      k: int = SHINGLE) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id reachable over links
    of similarity ``percent`` / 100 or more, its own included)."""
    j = _Join(docs, id_col, text_col, percent, k)
    star = j.posts.filter("head <> ref").select(*_ordered("head", "ref")).distinct()
    star = pinned(j.bounded(star), "star")
    roots = components(j.confirmed(star).select("a", "b"))

    # A second star, around the class of each list with the most shared signatures.
    left = pinned(_mixed(j.posts.drop("head"), roots), "mixed")
    weight = j.posts.groupBy("ref").agg(F.count(F.lit(1)).alias("w"))
    heads = left.join(weight, "ref").groupBy("sig").agg(F.max(F.struct("w", "ref", "root")).alias("c"))
    again = left.join(heads, "sig").filter(F.col("c.root") != F.col("root")).select(*_ordered("c.ref", "ref")).distinct()
    again = pinned(j.bounded(again.join(star, ["a", "b"], "left_anti")), "again")
    roots = merged(roots, j.confirmed(again).select("a", "b"))

    # The rest: all but the largest component of each list meet the whole list.
    left = pinned(_mixed(left, roots), "mixed")
    main = left.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("sig").agg(
        F.max(F.struct("c", "root")).alias("m")).select("sig", F.col("m.root").alias("main"))
    held = pinned(left.join(main, "sig").join(j.facts.select("ref", "n", "bits"), "ref"), "open")
    x, y = held.filter("root <> main").alias("x"), held.alias("y")
    rest = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.root") != F.col("y.root"))
                  & ((F.col("y.root") == F.col("y.main")) | (F.col("x.ref") < F.col("y.ref"))) & j.possible("x", "y"))
    rest = rest.select(*_ordered("x.ref", "y.ref")).distinct()
    rest = rest.join(star.unionByName(again), ["a", "b"], "left_anti")
    roots = merged(roots, j.confirmed(rest).select("a", "b"))

    rows = j.rows.select("doc_id", F.col("n").alias("n_shingles"), "key").join(j.classes, "key", "left")
    rows = rows.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    # Written, so that the join below reads two exchanges and a huge component can be split.
    least = pinned(rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    out = rows.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def q_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op12_jaccard_join": q_jaccard_join}

ORACLE = {"op12_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(sh) AS h FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e2.b FROM r JOIN e2 ON r.seen = e2.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id"""}

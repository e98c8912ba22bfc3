"""Benchmark decontamination by a prefix-filtered join of word windows (DataFrame functions only).

A benchmark item is a bag of windows of ``WINDOW`` consecutive words (an item with fewer
words is one window). A window occurs in a document only if all of its word shingles do, so
one *necessary* shingle per window is enough to find every occurrence: the prefix of a
containment join with threshold 1. Which shingle is free to choose; the rarest in the corpus
gives the fewest candidates.

1. Count, over all documents, the shingles that benchmark items hold (one scan, map-side
   combined) and keep for each window its rarest one, with its place in the item.
2. Probe every document position with those prefix shingles (one scan). Length and position
   bounds cut the overhang at both ends of text and item before anything is compared.
3. Verify the item words around the shingle, at most one window to each side, and keep runs
   that hold a whole window. Every occurrence is found from its own prefix shingle, so the
   union of these runs is exact.

The benchmark side is broadcast only below ``BROADCAST_ROWS`` counted rows of at most
2 * WINDOW words each; beyond that the probe is a shuffled join of (hash, row key, position)
and candidates meet their text again by row key. Nothing else is broadcast.

Edge cases: null or wordless text has no words and no hits; null or wordless items have no
windows; an item without id counts for hits but is not listed; rows that repeat a doc_id are
judged each on its own text; repeated items with one id count once in ``n_items``; very long
texts are read whole (their words are one array of a row); without items nothing is hit, without
documents the result is empty; other columns of both tables are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import ascii_lower, pick, pinned, read

# The contract's [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ as the set of what is left, which Java tests faster.
WORD = r"[a-z\x{80}-\x{10FFFF}0-9]+"
WORD_ANY_CASE = r"[a-z\x{80}-\x{10FFFF}A-Z0-9]+"
WINDOW = 13
SHINGLE = 3
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _shingle(ws: str, pos: str, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(ws), F.col(pos) + j) for j in range(k)])


def _bounded(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast hint only where the counted rows are within the bound."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _item_shingles(items: DataFrame, window: int, k: int) -> DataFrame:
    """One row per (item, window start, shingle in the window) of the items with shingle size k."""
    size = F.least(F.lit(window), F.size("iw"))
    starts = (items.filter(F.least(size, F.lit(SHINGLE)) == k).withColumn("size", size)
              .withColumn("start", F.explode(F.sequence(F.lit(0), F.size("iw") - F.col("size")))))
    return (starts.withColumn("ipos", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - k)))
            .withColumn("h", _shingle("iw", "ipos", k)))


def _run(ws: Column, pos: Column, iw: Column, ipos: Column, room: Column, step: int) -> Column:
    """How many words next to the anchor agree, going ``step`` (-1 or 1), at most ``room``."""
    grow = F.aggregate(
        F.sequence(F.lit(1), room), F.lit(0),
        lambda acc, d: F.when((acc == d - 1) & (F.get(ws, pos + d * step) == F.get(iw, ipos + d * step)), d).otherwise(acc))
    return F.when(room > 0, grow).otherwise(F.lit(0))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, item_id, a, b): runs [a, b] of document words covered by windows of an item.
    ``docs``: doc_id, text. ``items``: item_id, text. ``th`` is the hash of the text, which with
    doc_id names the row."""
    items = items.select("item_id", words(F.col("text")).alias("iw")).filter(F.size("iw") > 0).distinct()
    items = items.withColumn("ik", F.xxhash64("item_id", "iw"))
    toks = docs.filter(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("ws"))
    out = None
    sizes = items.select(F.least(F.size("iw"), F.lit(SHINGLE)).alias("k")).distinct()
    for k in sorted(r.k for r in sizes.collect()):  # at most SHINGLE values
        found = _hits_k(toks, items, window, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = dict(items.dtypes)["item_id"]  # no items: an empty frame of this shape
        out = toks.filter(F.lit(False)).select("doc_id", "th", F.lit(None).cast(kind).alias("item_id"),
                                               F.lit(0).alias("a"), F.lit(0).alias("b"))
    return out


def _hits_k(toks: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    shingles = _item_shingles(items, window, k)
    spots = toks.select("doc_id", "th", "ws", F.posexplode("ws").alias("pos", "w")).drop("w")
    spots = spots.withColumn("h", _shingle("ws", "pos", k))
    known = _bounded(shingles.select("h").distinct(), BROADCAST_ROWS)
    rarity = spots.select("h").join(known, "h").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    # Windows with a shingle that no document holds cannot occur: the inner join of the counts
    # leaves them with fewer shingles than they have.
    per_window = Window.partitionBy("ik", "start")
    ranked = shingles.select("ik", "start", "size", "ipos", "h").join(rarity, "h")
    ranked = ranked.withColumn("have", F.count(F.lit(1)).over(per_window)).filter(F.col("have") == F.col("size") - k + 1)
    ranked = ranked.withColumn("r", F.row_number().over(per_window.orderBy("n", "h", "ipos"))).filter("r = 1")
    prefix = ranked.select("ik", "h", "size", "ipos").distinct().join(items, "ik")
    lo = F.greatest(F.col("ipos") - (window - 1), F.lit(0))
    prefix = pinned(prefix.select("item_id", "h", "size", (F.col("ipos") - lo).alias("ip"),
                                  F.slice("iw", lo + 1, 2 * window - 1).alias("near")).distinct(), "prefix")
    if prefix.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = spots.join(F.broadcast(prefix), "h")
    else:
        # Rows equal in id and text share their hits: each side has them once, however often they repeat.
        where = spots.select("doc_id", "th", "pos", "h").distinct().join(prefix, "h").drop("h")
        found = where.alias("c").join(
            toks.dropDuplicates(["doc_id", "th"]).alias("t"), F.col("c.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("c.th") == F.col("t.th"))
        ).select("c.*", "t.ws")
    left = F.least(F.col("pos"), F.col("ip"))
    right = F.least(F.size("ws") - 1 - F.col("pos"), F.size("near") - 1 - F.col("ip"))
    found = found.filter(left + right + 1 >= F.col("size"))  # length and position bounds
    # Only the words around the anchor leave the generated code of the probe: the explode of one
    # element keeps the optimizer from evaluating the comparison on the whole text's words.
    lo = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    found = found.select("doc_id", "th", "item_id", "size", "ip", "near", "pos", (F.col("pos") - lo).alias("cp"),
                         F.explode(F.array(F.slice("ws", lo + 1, 2 * window - 1))).alias("text"))
    args = F.col("text"), F.col("cp"), F.col("near"), F.col("ip")
    l = F.least(F.col("cp"), F.col("ip"))
    r = F.least(F.size("text") - 1 - F.col("cp"), F.size("near") - 1 - F.col("ip"))
    found = found.filter(F.get("text", F.col("cp")) == F.get("near", F.col("ip")))
    found = found.withColumn("l", _run(*args, l, -1)).withColumn("r", _run(*args, r, 1))
    return found.filter(F.col("l") + F.col("r") + 1 >= F.col("size")).select(
        "doc_id", "th", "item_id", (F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  min_share: float = 0.05) -> DataFrame:
    """Per document row: doc_id, th (hash of the text), n_words, n_hit, item_ids (sorted as strings), n_items,
    contaminated (some hit, and at least ``min_share`` of the words hit)."""
    d = pick(docs, doc_id=id_col, text=text_col)
    b = pick(benchmark, item_id=item_col, text=item_text_col)
    spans = hits(d, b, window)
    per_doc = spans.groupBy("doc_id", "th").agg(
        F.collect_set(F.struct("a", "b")).alias("runs"),
        F.collect_set(F.col("item_id").cast("string")).alias("items"))
    per_doc = per_doc.select(
        F.col("doc_id").alias("hit_id"), "th",
        F.size(F.array_distinct(F.flatten(F.transform("runs", lambda s: F.sequence(s["a"], s["b"]))))).alias("hit"),
        F.sort_array("items").alias("items"))
    base = d.select("doc_id", F.xxhash64("text").alias("dh"),
                    F.coalesce(F.regexp_count("text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    out = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("dh") == F.col("th")), "left")
    n_hit = F.coalesce(F.col("hit"), F.lit(0)).cast("long")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    per = round(1 / min_share)
    return out.select("doc_id", F.col("dh").alias("th"), "n_words", n_hit.alias("n_hit"), items.alias("item_ids"),
                      F.size(items).cast("long").alias("n_items"),
                      ((n_hit > 0) & (per * n_hit >= F.col("n_words"))).alias("contaminated"))


def q_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op1_decontaminate": q_decontaminate}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = {"op1_decontaminate": rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k),
hit AS (
  SELECT p.doc_id, bw.item_id, p.s, p.k FROM (SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win FROM p) p
  JOIN bw USING (k, win)),
n AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS q FROM hit) GROUP BY doc_id),
i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""}

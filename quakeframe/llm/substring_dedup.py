"""Substring dedup by difference-cover anchors: remove every word that lies in a window of
``window`` consecutive words whose word sequence also starts anywhere else.

Let D be a difference cover modulo v: for any two positions i, j some shift s < v puts both
i + s and j + s on D. Two equal windows starting at i and j therefore hold an equal *anchor*
(the ``window`` - v + 1 words from i + s) at a cover position of each. Only |D| / v of all
positions (5 of 21) are hashed and shuffled to find the candidates.

1. Anchors: numpy hashes the anchors of whole texts; equal ones are found over all rows.
2. Extension: the windows around a shared anchor (at most v starts each) are hashed with 96
   bits, and equal ones are found the same way. That is exact for every pair of places at once;
   no pair of places is ever listed, so a passage in a third of all documents costs no more
   than as many rows.
3. The covered words are cut from each text.

*Finding equal keys* ships packed numpy arrays, not a row per key: each task posts its keys by
hash bucket, and keys that repeat inside the task are already known as shared and post a single
marker. A hot key thus sends one entry per task to its bucket. Answers return packed by home
bucket of the row. The number of buckets follows spark.sql.shuffle.partitions, so a bucket
stays a fixed share of a partition. The texts are shuffled once (the exchange is reused).

Edge cases: null, empty and wordless texts have no words and lose none; texts shorter than the
window lose none; repeated rows and equal texts lose all words if they have a window, since
each window starts elsewhere too; rows that share a doc_id are different places; rows equal in
id and text are different places as well; very long texts are cut whole; an empty table gives an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import read, with_ref
from quakeframe.llm.textwords import Words, chunks

WINDOW = 35
PERIOD = 21
COVER = (3, 6, 7, 12, 14)  # every difference modulo 21 occurs among these
BUCKETS_PER_PARTITION = 2
FLUSH = 1_500_000  # keys that a task gathers before it posts them
_PLAIN = 512  # bytes up to which a blob is not compressed

_FIELDS = (("k1", np.uint64), ("k2", np.uint32), ("many", np.uint8), ("pos", np.int32), ("ref", np.int64))
_PLACE = (("pos", np.int32), ("ref", np.int64))


def _pack(fields, arrays: dict, sel) -> bytes:
    """The selected entries, byte planes apart (they compress well), ids as differences."""
    planes = []
    for name, kind in fields:
        a = arrays[name][sel]
        if name == "ref":
            a = np.diff(a, prepend=np.int64(0))
        planes.append(np.ascontiguousarray(a.astype(kind, copy=False)).view(np.uint8).reshape(len(a), -1).T.tobytes())
    raw = b"".join(planes)
    return b"\0" + raw if len(raw) <= _PLAIN else b"\1" + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(fields, blobs: list[bytes]) -> dict:
    width = sum(np.dtype(kind).itemsize for _, kind in fields)
    parts: dict = {name: [] for name, _ in fields}
    unzip = zstandard.ZstdDecompressor()
    for blob in blobs:
        raw = np.frombuffer(blob[1:] if blob[0] == 0 else unzip.decompress(blob[1:]), np.uint8)
        n, at = len(raw) // width, 0
        for name, kind in fields:
            size = np.dtype(kind).itemsize
            a = np.ascontiguousarray(raw[at: at + n * size].reshape(size, n).T).reshape(-1).view(kind)
            parts[name].append(np.cumsum(a) if name == "ref" else a)
            at += n * size
    return {name: np.concatenate(p) if p else np.zeros(0, dict(fields)[name]) for name, p in parts.items()}


def _groups(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together, and the number of the group of each in that order."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.cumsum(new) - 1


def _by(bucket: np.ndarray):
    """(bucket, indices in it) for each bucket, indices ascending."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.diff(b, prepend=b[:1] - 1))
    for i, j in zip(cut, [*cut[1:], len(b)]):
        yield int(b[i]), order[i:j]


def _post(held: list[dict], buckets: int) -> pa.RecordBatch:
    """Rows (bucket, blob) of the gathered keys. Buckets below zero hold places that are
    already known to be shared."""
    e = {name: np.concatenate([h[name] for h in held]) for name in ("k1", "k2", "pos", "ref")}
    order, group = _groups(e["k1"], e["k2"])
    count = np.bincount(group)
    known = np.zeros(len(order), bool)
    known[order] = count[group] > 1
    first = np.zeros(len(order), bool)
    first[order[np.flatnonzero(np.diff(group, prepend=-1))]] = True
    e["many"] = known.astype(np.uint8)
    where, blobs = [], []
    sent = np.flatnonzero(first)  # a key that is there once, or one marker for those of a key
    for b, idx in _by((e["k1"][sent] % np.uint64(buckets)).astype(np.int64)):
        where.append(b)
        blobs.append(_pack(_FIELDS, e, sent[idx]))
    sure = np.flatnonzero(known)
    for b, idx in _by(e["ref"][sure] % buckets):
        where.append(-1 - b)
        blobs.append(_pack(_PLACE, e, sure[idx]))
    return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _posting(entries, buckets: int):
    """A mapInArrow function that posts what ``entries(batch)`` yields: dicts k1, k2, pos, ref."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for e in entries(batch):
                held.append(e)
                n += len(e["k1"])
                if n >= FLUSH:
                    yield _post(held, buckets)
                    held, n = [], 0
        if n:
            yield _post(held, buckets)
    return run


def _answer(buckets: int):
    """Of one bucket: the places of keys with two entries or more, packed by home."""
    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        if table.column("bucket")[0].as_py() < 0:
            e = _unpack(_PLACE, blobs)
        else:
            e = _unpack(_FIELDS, blobs)
            order, group = _groups(e["k1"], e["k2"])
            shared = np.zeros(len(order), bool)
            shared[order] = np.bincount(group, weights=1 + e["many"][order])[group] > 1
            e = {name: e[name][shared & (e["many"] == 0)] for name, _ in _PLACE}
        homes, out = [], []
        for b, idx in _by(e["ref"] % buckets):
            idx = idx[np.argsort(e["ref"][idx], kind="stable")]
            homes.append(b)
            out.append(_pack(_PLACE, e, idx))
        return pa.table({"home": pa.array(homes, pa.int32()), "blob": pa.array(out, pa.binary())})
    return run


def _gathered(table: pa.Table) -> pa.Table:
    """Of one home: each row's shared positions, ascending, as packed int32."""
    e = _unpack(_PLACE, table.column("blob").to_pylist())
    order = np.lexsort((e["pos"], e["ref"]))
    ref, pos = e["ref"][order], e["pos"][order]
    cut = np.flatnonzero(np.diff(ref, prepend=ref[:1] - 1)) if len(ref) else np.zeros(0, int)
    at = [np.unique(pos[i:j]).tobytes() for i, j in zip(cut, [*cut[1:], len(ref)])]
    return pa.table({"ref": pa.array(ref[cut], pa.int64()), "at": pa.array(at, pa.binary())})


def shared_places(df: DataFrame, entries, buckets: int) -> DataFrame:
    """ref, at: the positions whose key occurs at another place too. ``entries`` turns an Arrow
    batch of ``df`` into keys (k1, k2) with their place (pos, ref)."""
    posts = df.mapInArrow(_posting(entries, buckets), "bucket int, blob binary")
    answers = posts.groupBy("bucket").applyInArrow(_answer(max(1, buckets // 4)), "home int, blob binary")
    return answers.groupBy("home").applyInArrow(_gathered, "ref long, at binary")


def _places(w: Words, refs: np.ndarray, at: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> dict:
    row = w.row[at]
    return {"k1": k1[at], "k2": k2[at], "pos": (at - w.first[row]).astype(np.int32), "ref": refs[row]}


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    k = window - period + 1
    on = np.zeros(period, bool)
    on[list(cover)] = True

    def entries(batch):
        refs = batch.column("ref").to_numpy(zero_copy_only=False)
        for i, j, data, offs in chunks(batch.column("text")):
            w = Words(data, offs)
            n = len(w) - k + 1
            if n <= 0:
                continue
            pos = np.arange(n) - w.first[w.row[:n]]
            long = np.diff(w.first)[w.row[:n]] >= window
            at = np.flatnonzero(w.whole(k) & long & on[pos % period])
            # The anchors only name candidates: 48 bits do.
            key = w.windows(k) >> np.uint64(16)
            yield _places(w, refs[i:j], at, key, np.zeros(n, np.uint32))
    return entries


def _extended(window: int, period: int):
    def entries(batch):
        refs = batch.column("ref").to_numpy(zero_copy_only=False)
        places = batch.column("at").to_pylist()
        for i, j, data, offs in chunks(batch.column("text")):
            w = Words(data, offs)
            n = len(w) - window + 1
            if n <= 0:
                continue
            anchor = np.concatenate([np.frombuffer(places[r], np.int32) + w.first[r - i] for r in range(i, j)])
            step = np.zeros(len(w) + 1, np.int32)  # starts from anchor - period + 1 to anchor
            np.add.at(step, np.maximum(anchor - period + 1, 0), 1)
            np.add.at(step, anchor + 1, -1)
            near = np.cumsum(step)[:n] > 0
            # A start before the row's first word belongs to another row and is only a spare candidate.
            at = np.flatnonzero(near & w.whole(window))
            k2 = (w.windows(window, "other") >> np.uint64(32)).astype(np.uint32)
            yield _places(w, refs[i:j], at, w.windows(window), k2)
    return entries


def _cut(window: int):
    def run(batches):
        for batch in batches:
            places = batch.column("at").to_pylist()
            n_words, n_removed, kept, digest = [], [], [], []
            for i, j, data, offs in chunks(batch.column("text")):
                raw = data.tobytes()
                for r in range(j - i):
                    words = raw[offs[r]: offs[r + 1]].split()  # bytes.split() splits at ASCII white space
                    n_words.append(len(words))
                    at = places[i + r]
                    if at:
                        step = np.zeros(len(words) + 1, np.int32)
                        starts = np.frombuffer(at, np.int32)
                        step[starts] += 1
                        np.add.at(step, starts + window, -1)
                        keep = np.cumsum(step)[:-1] == 0
                        words = [words[x] for x in np.flatnonzero(keep)]
                    n_removed.append(n_words[-1] - len(words))
                    text = b" ".join(words)
                    kept.append(text)
                    digest.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])
    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept (the words left, one space apart),
    kept_sha256."""
    if len({(a - b) % period for a in cover for b in cover}) < period or window <= period:
        raise ValueError("cover must hold every difference modulo period, and window exceed period")
    d = with_ref(docs, id_col, text_col)
    d = d.select(F.coalesce("ref", F.lit(0)).alias("ref"), "doc_id", "text")
    if dict(d.dtypes)["doc_id"] != "bigint":
        d = d.withColumn("doc_id", F.col("doc_id").cast("string"))
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = shared_places(d.select("ref", "text"), _anchors(window, period, cover), buckets)
    found = shared_places(d.join(anchors, "ref"), _extended(window, period), buckets)
    kind = dict(d.dtypes)["doc_id"]
    return d.join(found, "ref", "left").mapInArrow(
        _cut(window), f"doc_id {kind}, n_words long, n_removed long, kept string, kept_sha256 string")


def q_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(read(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op7_substring_dedup": q_substring_dedup}

ORACLE = {"op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
m AS (SELECT win FROM p GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(s, s + 35)) AS q FROM p JOIN m USING (win))),
k AS (SELECT doc_id, list(q) AS qs, count(*) AS n FROM c GROUP BY doc_id),
t AS (SELECT d.doc_id, d.w[u.q] AS word, u.q FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS q) u
      LEFT JOIN c ON c.doc_id = d.doc_id AND c.q = u.q WHERE c.q IS NULL),
j AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept FROM t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(j.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN j USING (doc_id)"""}

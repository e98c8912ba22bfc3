"""Quality rules: fixed counts per text, and perplexity bands from a modified Kneser-Ney model of
bytes over the running text, per language.

The words of a text, ASCII-lowered, with one space between them, make its running text; each of its
bytes is predicted from those before it, across word borders. The model is counted and
estimated by Spark, from all documents:

1. Tasks gather the distinct ``GATHER_ORDER``-byte grams of their texts, per language, and ship
   them as sorted, delta-packed blocks, dealt to buckets by what is behind their first byte. A bucket
   is united block by block: what is held is the distinct grams of a bucket, however many tasks
   saw them. The grams so gathered grow with the input.
2. Every order of the model, from ``ORDER`` = ``GATHER_ORDER`` - 1 down, counts distinct left
   neighbours (the continuation counts that Kneser-Ney has below its top): a text copied a
   thousand times adds nothing to the chances of its grams, so copies do not look better than
   other texts. Three discounts per language and order come from the counts of counts;
   probabilities interpolate upward order by order - joins and aggregations on the gram tables.
3. The model is a sorted array of 64-bit hashes of (language, order, gram) beside their log
   probabilities, and one of contexts beside their back-off weights (``Model``). The texts that were
   counted hold no other grams than the table's longest, so for their scores only these are
   broadcast, up to ``BROADCAST_GRAMS`` counted ones (12 bytes each); beyond that, documents ship
   their distinct grams and the scores come from a join with the gram table.
4. A document's score is its log perplexity per word. Histograms per language (fixed bins,
   combined on the map side) give the median of the scores and the quartiles of the deviations
   from it, times the root of the number of words; from them come the lower and upper band, and
   documents outside are rejected. Only documents that pass the fixed rules enter the histograms.

``LOW_BAND``, ``HIGH_BAND`` and the length of the grams are parameters. They were chosen by looking
at all labels of one small table (README); none were held out.

Edge cases: null, empty and wordless text has no words, fails the fixed rules and has no
perplexity; a null language is a language of its own; repeated rows are judged alike; very long
texts are read whole (a chunk of work grows to the text); an empty table gives an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import pick, pinned, read
from quakeframe.llm.textwords import _BYTE, LOWER, Words, _runs, chunks, mix

GATHER_ORDER = 7  # bytes of the grams that are gathered; they must fit a long beside the order
ORDER = GATHER_ORDER - 1  # bytes of the longest grams that the model scores
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
LOW_BAND = 2.5  # interquartile ranges from the median down and up, of deviations of log
HIGH_BAND = 2.5  # perplexity from the median times the root of the number of words
MIN_RANGE = 0.005  # least interquartile range of these
BIN = 0.005
FAR = 500.0  # deviations are cut here, so that their bins are bounded
BROADCAST_GRAMS = 8_000_000
LANGUAGES = 10_000  # per-language tables of at most so many rows are broadcast
GATHER = 2_000_000  # grams that a task unites at once; it ships them from twice as many distinct ones on
BUCKETS = 512
_U = np.uint64
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _per_row(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of integer values between offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def fixed_counts(w: Words, data: np.ndarray, offs: np.ndarray, window: int) -> dict[str, np.ndarray]:
    rows = len(offs) - 1
    salt = mix(np.arange(1, rows + 1, dtype=_U))
    out = {"n_words": np.diff(w.first), "word_chars": _per_row(w.solid & ((data & 0xC0) != 0x80), offs),
           "n_symbols": _per_row(_SYMBOL[data], offs)}
    # Lines: cut behind each newline and at row ends.
    cuts = np.zeros(len(data) + 1, bool)
    cuts[offs] = True
    newline = data == 10
    cuts[1:] |= newline
    begin = np.flatnonzero(cuts)
    begin, end = begin[:-1], begin[1:]
    end = end - newline[end - 1] if len(end) else end
    some = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end = begin[some], end[some]
    row = np.searchsorted(offs, begin, side="right") - 1
    _, first = np.unique(mix(_runs(_BYTE[data], begin, end, "byte")) ^ salt[row], return_index=True)
    out["n_dup_lines"] = np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)
    whole = np.flatnonzero(w.whole(window))
    key = w.windows(window)[whole] ^ salt[w.row[whole]]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = whole[count[inverse] > 1]
    step = np.zeros(len(w) + 1, np.int64)
    step[twice] += 1
    np.add.at(step, twice + window, -1)
    out["n_repeat_words"] = np.bincount(w.row[np.cumsum(step)[:-1] > 0], minlength=rows)
    return out


def running_grams(w: Words, order: int = GATHER_ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The running text of each row (its words, one space between them): of every byte the gram of
    ``order`` bytes that ends there, zeros before the row, and where each row begins in them."""
    keep = w.solid.copy()
    more = np.ones(len(w), bool)  # words with another one behind them in their row
    more[w.first[1:][np.diff(w.first) > 0] - 1] = False
    keep[w.ends[more]] = True
    text = np.where(w.solid, w.data, np.uint8(32))[keep]
    begin = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=begin[1:])
    begin = begin[w.offs]
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[8 - 1: -1] = text  # eight bytes that end at each byte, read as one big-endian number
    code = np.ndarray(len(text), ">u8", padded, 0, (1,)).astype(_U) & _U((1 << 8 * order) - 1)
    size = np.diff(begin)
    for i in range(order - 1):  # what lies before the row is none of its context
        at = begin[:-1][size > i] + i
        code[at] &= _U((1 << 8 * (i + 1)) - 1)
    return code, begin


_BELOW = _U((1 << 8 * ORDER) - 1)


def _distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by a sort: for millions of hashes much faster than np.unique)."""
    a = np.sort(a)
    return a[np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))] if len(a) else a


def pack(grams: np.ndarray) -> bytes:
    """Sorted grams as differences, byte by byte of all of them: mostly zeros, for the shuffle's
    compression."""
    return np.diff(grams, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(block: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(8, -1).T).view(_U).ravel(), dtype=_U)


def _blocks(held: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
    lang, bucket, block = [], [], []
    for key, parts in held.items():
        grams = _distinct(np.concatenate(parts))
        to = (mix(grams & _BELOW) % _U(BUCKETS)).astype(np.int16)
        order = np.argsort(to, kind="stable")
        grams, to = grams[order], to[order]
        cuts = np.flatnonzero(np.diff(to)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(to)]):
            lang.append(key)
            bucket.append(int(to[i]))
            block.append(pack(grams[i:j]))
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(bucket, pa.int32()), pa.array(block, pa.binary())],
                                      ["lang", "bucket", "block"])


def _gathered(batches):
    """Blocks of the distinct grams of a task's texts, per language and bucket. What is held is
    the distinct grams so far and as many again that are not yet united with them."""
    held: dict[int, list[np.ndarray]] = {}
    new = 0
    for batch in batches:
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        for i, j, data, offs in chunks(batch.column("text")):
            code, begin = running_grams(Words(data, offs, lower=True))
            size = np.diff(begin)
            for key in np.unique(langs[i:j][size > 0]):
                some = _distinct(code[np.repeat(langs[i:j] == key, size)])
                held.setdefault(int(key), []).append(some)
                new += len(some)
            if new >= GATHER:
                held = {k: [_distinct(np.concatenate(v))] for k, v in held.items()}
                new = 0
                if sum(len(v[0]) for v in held.values()) >= 2 * GATHER:
                    yield _blocks(held)
                    held = {}
    if held:
        yield _blocks(held)


def _united(batches):
    """Of blocks side by side by (lang, bucket): each gram behind the first byte, with the number of
    distinct first bytes."""
    key, held = None, []

    def counted():
        grams, n = np.unique(held[0] & _BELOW, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), key[0])), pa.array(grams.view(np.int64)), pa.array(n)],
                                          ["lang", "gram", "n"])

    for batch in batches:
        for lang, bucket, block in zip(*(batch.column(c).to_pylist() for c in ("lang", "bucket", "block"))):
            if key is not None and (lang, bucket) != key:
                held = [_distinct(np.concatenate(held))]
                yield counted()
                held = []
            key = (lang, bucket)
            held.append(unpack(block))
            if sum(len(h) for h in held[1:]) > max(GATHER, len(held[0])):
                held = [_distinct(np.concatenate(held))]
    if held:
        held = [_distinct(np.concatenate(held))]
        yield counted()


def count_grams(docs: DataFrame) -> DataFrame:
    """``docs``: lang (hash), text. Returns lang, gram (ORDER bytes), n: its distinct left
    neighbours over all texts."""
    blocks = docs.select("lang", "text").mapInArrow(_gathered, "lang long, bucket int, block binary")
    blocks = blocks.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return blocks.mapInArrow(_united, "lang long, gram long, n long")


def kneser_ney(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modified Kneser-Ney of the full-order counts: lang, ord, gram, logp for every gram of every
    order, and lang, ord, ctx, bow (log weight of the lower order behind the context)."""
    counts = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        mask = (1 << 8 * k) - 1
        counts[k] = pinned(counts[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(
            F.count(F.lit(1)).alias("n")), f"count{k}")
    few = counts[1].select("lang").distinct().count() <= LANGUAGES
    probs, weights, lower = None, None, None
    for k in range(1, ORDER + 1):
        c = counts[k]
        of = [F.coalesce(F.sum((F.col("n") == i).cast("long")), F.lit(0)).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)]
        t = c.groupBy("lang").agg(*of)
        y = F.coalesce(F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2")), F.lit(0.0))
        d = [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.coalesce(
            F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}")), F.lit(0.0)))).alias(f"d{i}") for i in (1, 2, 3)]
        t = t.select("lang", *d)
        c = c.join(F.broadcast(t) if few else t, "lang").withColumn("ctx", F.shiftright("gram", 8))
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        ctx = c.groupBy("lang", "ctx").agg(
            F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("int")).alias("n1"),
            F.sum((F.col("n") == 2).cast("int")).alias("n2"), F.sum((F.col("n") > 2).cast("int")).alias("n3"),
            F.first("d1").alias("e1"), F.first("d2").alias("e2"), F.first("d3").alias("e3"))
        ctx = ctx.select("lang", "ctx", "total", ((F.col("e1") * F.col("n1") + F.col("e2") * F.col("n2")
                                                   + F.col("e3") * F.col("n3")) / F.col("total")).alias("w"))
        p = c.select("lang", "ctx", "gram", (F.col("n") - cut).alias("left")).join(ctx, ["lang", "ctx"])
        if lower is None:
            p = p.withColumn("below", F.lit(1 / 257))
        else:
            p = p.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(
                lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("below")), ["lang", "short"])
        lower = p.select("lang", "gram", (F.col("left") / F.col("total") + F.col("w") * F.col("below")).alias("p"))
        lower = pinned(lower, f"order{k}")
        row = lower.select("lang", F.lit(k).alias("ord"), "gram", F.log("p").cast("float").alias("logp"))
        back = ctx.select("lang", F.lit(k).alias("ord"), "ctx", F.log("w").cast("float").alias("bow"))
        probs = row if probs is None else probs.unionByName(row)
        weights = back if weights is None else weights.unionByName(back)
    return probs, weights


def _key(lang: np.ndarray, order, gram: np.ndarray) -> np.ndarray:
    return mix(gram.view(_U) | (np.asarray(order).astype(_U) << _U(48))) ^ mix(lang.view(_U) + _U(1))


class Model:
    """Sorted hash arrays: keys and log probabilities of grams, keys and weights of contexts (grams
    that no counted text has back off to these)."""

    def __init__(self, probs: pa.Table, weights: pa.Table):
        self.key, self.logp = self._sorted(probs, "gram", "logp")
        self.ctx, self.bow = self._sorted(weights, "ctx", "bow")

    @classmethod
    def of(cls, key: np.ndarray, logp: np.ndarray) -> "Model":
        """The longest grams alone: enough for the texts that were counted."""
        m = cls.__new__(cls)
        order = np.argsort(key)
        m.key, m.logp = key[order], logp[order]
        m.ctx, m.bow = np.zeros(0, _U), np.zeros(0, np.float32)
        return m

    @staticmethod
    def _sorted(t: pa.Table, gram: str, value: str):
        key = _key(t["lang"].to_numpy(), t["ord"].to_numpy(), t[gram].to_numpy())
        order = np.argsort(key)
        return key[order], t[value].to_numpy()[order]

    @staticmethod
    def _find(keys, values, key) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.float32)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[at] == key, values[at]

    def score(self, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last byte; unseen grams back off."""
        out = np.zeros(len(gram))
        left = np.arange(len(gram))
        for k in range(ORDER, 0, -1):
            g = gram[left] & np.int64((1 << 8 * k) - 1)
            hit, p = self._find(self.key, self.logp, _key(lang[left], k, g))
            out[left[hit]] += p[hit]
            left, g = left[~hit], g[~hit]
            if not len(left):
                return out
            known, bow = self._find(self.ctx, self.bow, _key(lang[left], k, g >> np.int64(8)))
            out[left[known]] += bow[known]
        out[left] += np.log(1 / 257)
        return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scored(model):
    """Rows of doc_id, lang, the fixed counts and log perplexity (null without words, or model)."""
    def run(batches):
        m = model.value if model is not None else None
        for batch in batches:
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            cols: dict = {name: [] for name in _COUNTS}
            scores = []
            for i, j, data, offs in chunks(batch.column("text")):
                w = Words(data, offs)
                for name, values in fixed_counts(w, data, offs, REPEAT_WINDOW).items():
                    cols[name].append(values)
                w.data = LOWER[data]
                scores.append(_log_perplexity(m, w, langs[i:j], j - i))
            flat = [np.concatenate(cols[n]) if cols[n] else np.zeros(0, np.int64) for n in _COUNTS]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), batch.column("th"), *[pa.array(c, pa.int64()) for c in flat],
                 pa.array(score, pa.float64(), mask=np.isnan(score))], ["doc_id", "lang", "th", *_COUNTS, "score"])
    return run


def _log_perplexity(m, w: Words, langs: np.ndarray, rows: int) -> np.ndarray:
    """Per row: minus the log probability of its running text, per word."""
    out = np.full(rows, np.nan)
    if m is None or not len(w):
        return out
    code, begin = running_grams(w, ORDER)
    size = np.diff(begin)
    key = _key(np.repeat(langs, size), ORDER, code)
    order = np.argsort(key)  # looked up in the order of the model's own keys
    hit, found = m._find(m.key, m.logp, key[order])
    logp = np.empty(len(key))
    logp[order] = found
    if not hit.all():
        lost = order[~hit]
        logp[lost] = m.score(np.repeat(langs, size)[lost], code[lost].view(np.int64))
    n = np.diff(w.first)
    some = n > 0
    out[some] = -np.add.reduceat(logp, begin[:-1][some]) / n[some]
    return out


def _doc_grams(batches):
    """doc_id, th, lang, gram, n of each document: for scores by join."""
    for batch in batches:
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        for i, j, data, offs in chunks(batch.column("text")):
            w = Words(data, offs, lower=True)
            if not len(w):
                continue
            code, begin = running_grams(w, ORDER)
            row = np.repeat(np.arange(j - i), np.diff(begin))
            _, first, n = np.unique(code ^ mix(np.arange(1, j - i + 1, dtype=_U))[row], return_index=True, return_counts=True)
            row = row[first] + i
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), batch.column("th").take(pa.array(row)),
                 pa.array(langs[row]), pa.array(code[first].view(np.int64)), pa.array(n)], ["doc_id", "th", "lang", "gram", "n"])


def _hashed(batches):
    """The rows of a task (lang, gram, logp) as two arrays of bytes: the keys and the values."""
    keys, values = [np.zeros(0, _U)], [np.zeros(0, np.float32)]
    for batch in batches:
        lang, gram, logp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "gram", "logp"))
        keys.append(_key(lang, ORDER, gram))
        values.append(logp)
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (keys, values)], ["k", "v"])


def _top_model(full: DataFrame) -> Model:
    """The model of the longest grams, hashed by the tasks: the driver joins 12 bytes a gram."""
    rows = full.select("lang", "gram", "logp").mapInArrow(_hashed, "k binary, v binary").collect()
    return Model.of(np.concatenate([np.zeros(0, _U), *[np.frombuffer(r["k"], _U) for r in rows]]),
                    np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(r["v"], np.float32) for r in rows]]))


def perplexities(d: DataFrame, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``d``: doc_id, lang (hash), th, text. Fixed counts and score (log perplexity per word) of each row."""
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang long, th long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", score double"
    grams = pinned(count_grams(d), "grams")
    probs, _ = kneser_ney(grams)
    full = probs.filter(F.col("ord") == ORDER)  # every gram of the texts is in it, as it was counted from them
    model = None
    if grams.count() <= broadcast_grams:
        model = d.sparkSession.sparkContext.broadcast(_top_model(full))
    base = d.mapInArrow(_scored(model), schema)
    if model is not None:
        return base
    base = base.drop("score")
    each = d.mapInArrow(_doc_grams, f"doc_id {kind}, th long, lang long, gram long, n long").distinct()
    sums = each.join(full, ["lang", "gram"]).groupBy(F.col("doc_id").alias("sid"), F.col("th").alias("sth"), F.col("lang").alias("sl")).agg(
        (-F.sum(F.col("n") * F.col("logp"))).alias("nll"))
    base = base.join(sums, F.col("doc_id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth")) & (F.col("lang") == F.col("sl")), "left")
    return base.withColumn("score", F.when(F.col("n_words") > 0, F.col("nll") / F.col("n_words"))).drop("sid", "sth", "sl", "nll")


def quantiles(rows: DataFrame, value, **at: float) -> DataFrame:
    """Per lang the named quantiles of ``value``, from a histogram of bins of ``BIN``: bounded
    whatever the number of documents."""
    bins = rows.groupBy("lang", F.floor(value / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("lang").orderBy("bin")
    bins = bins.withColumn("to", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return bins.groupBy("lang").agg(*[
        (F.min(F.when(F.col("to") >= q * F.col("all"), F.col("bin"))) * BIN).alias(name) for name, q in at.items()])


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  low: float = LOW_BAND, high: float = HIGH_BAND, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Per document row: doc_id, th (hash of the text), the fixed counts, base_failed, kept,
    log_perplexity (per word)."""
    d = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    d = d.select("doc_id", F.xxhash64("lang").alias("lang"), F.xxhash64("text").alias("th"), "text")
    scored = pinned(perplexities(d, broadcast_grams), "scored")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    sound = scored.filter(~failed & F.col("score").isNotNull())
    mid = pinned(quantiles(sound, F.col("score"), m=0.5), "medians")
    # One row a language, counted: documents need no exchange by language, of which one may hold most.
    small = F.broadcast if mid.count() <= LANGUAGES else (lambda t: t)
    # A mean over n words scatters as 1 / sqrt(n): bands are set on deviations times that root.
    far = F.least(F.greatest((F.col("score") - F.col("m")) * F.sqrt("n_words"), F.lit(-FAR)), F.lit(FAR))
    quart = quantiles(sound.join(small(mid), "lang"), far, q1=0.25, q2=0.5, q3=0.75)
    width = F.greatest(F.col("q3") - F.col("q1"), F.lit(MIN_RANGE))
    bands = mid.join(quart, "lang").select(F.col("lang").alias("bl"), "m", (F.col("q2") - low * width).alias("low"), (F.col("q2") + high * width).alias("high"))
    out = scored.join(small(pinned(bands, "bands")), F.col("lang") == F.col("bl"), "left")
    inside = F.coalesce(far.between(F.col("low"), F.col("high")), F.lit(False))
    return out.select("doc_id", "th", *_COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"),
                      F.col("score").alias("log_perplexity"))


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read(spark, sf_dir, "documents")).drop("th")


QUERIES = {"op8_quality": q_quality}

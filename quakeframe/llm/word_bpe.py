"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold, for each symbol of a word, the rank of the pair it forms with the
next living symbol (rank and place in one integer, so the smallest is the leftmost pair of the
lowest rank). The root is the next merge. Merging changes at most three leaves - the merged
symbol's, its left neighbour's and that of the symbol that died - and each is carried up the
tree in logarithmically many steps, until the root says that no pair can merge.

Distinct words of a batch are encoded side by side: one tree per row of a numpy array, grouped
by tree size, one merge in every unfinished word per step. Words longer than ``WIDE`` symbols
get a tree of their own. Each worker remembers at most ``REMEMBER`` words.

Text is brought to NFC and lower case and split by the vocabulary's pattern; white space is
dropped. Special strings become their ids, as the tokenizers library does by default. Decoding
joins the tokens' texts with one space. Rows are independent: no shuffle, memory bounded by one
Arrow batch and the longest text.

Edge cases: null and empty text have no tokens and decode to the empty string; repeated rows
are encoded alike; null ids are carried along; very long texts are encoded whole, word by word, and
a very long word by a tree of its own; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quakeframe.llm.bpe_files import SPACE, BpeFile, decimal_only, load
from quakeframe.llm.common import pick, read
from quakeframe.session import ship

VOCABULARY = "word_bpe_49k.json"
REMEMBER = 400_000  # some 150 MB
WIDE = 64
TOGETHER = 1 << 18  # characters of text whose words are encoded together
_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
# The same for texts whose only numbers are decimal digits, where the faster engine's classes agree.
_DECIMAL = re.compile(rf"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\w{SPACE}]|_)+")
_PLACE = 24  # bits for the place in a leaf
_NONE = np.int64(2**62)


class Encoder:
    def __init__(self, bpe: BpeFile):
        self.bpe = bpe
        pairs = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in bpe.merges.items())
        self.keys = np.array([p[0] for p in pairs] or [-1], np.int64)
        self.rank = np.array([p[1] for p in pairs] or [0], np.int64)
        self.merged = np.zeros(len(self.rank), np.int64)
        self.merged[self.rank] = [p[2] for p in pairs] or [0]
        self.byte = np.array(bpe.byte_id, np.int64)
        self.last = np.array(bpe.last_byte_id, np.int64)
        self.special = regex.compile("|".join(map(regex.escape, sorted(bpe.special, key=len, reverse=True)))) if bpe.special else None
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and place of the pairs, or none where they do not merge (right < 0: no pair)."""
        key = left << 32 | np.maximum(right, 0)
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[i] == key) & (right >= 0)
        return np.where(ok, self.rank[i] << _PLACE | at, _NONE)

    def _trees(self, sym: np.ndarray) -> np.ndarray:
        """Encode the rows of ``sym`` (symbols, then -1) all at once; dead symbols become -1."""
        words, size = sym.shape
        at = np.arange(size)
        nxt = np.tile(np.append(at[1:], 0), (words, 1))  # 0: no next, as place 0 is no one's next
        nxt[:, :-1][sym[:, 1:] < 0] = 0
        prv = np.tile(at - 1, (words, 1))
        tree = np.full((words, 2 * size), _NONE)
        right = np.full_like(sym, -1)
        right[:, :-1] = sym[:, 1:]
        tree[:, size:] = np.where(sym >= 0, self._leaf(sym, right, at), _NONE)
        for i in range(size - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        live = np.arange(words)
        while True:
            root = tree[live, 1]
            more = root < _NONE
            live, root = live[more], root[more]
            if not len(live):
                return sym
            p = root & ((1 << _PLACE) - 1)
            new = self.merged[root >> _PLACE]
            dead = nxt[live, p]
            after = nxt[live, dead]
            sym[live, p] = new
            sym[live, dead] = -1
            nxt[live, p] = after
            has = np.flatnonzero(after)
            prv[live[has], after[has]] = p[has]
            tree[live, size + dead] = _NONE
            tree[live, size + p] = self._leaf(new, np.where(after > 0, sym[live, after], -1), p)
            b = np.flatnonzero(prv[live, p] >= 0)
            lb, pb = live[b], prv[live[b], p[b]]
            tree[lb, size + pb] = self._leaf(sym[lb, pb], new[b], pb)
            row = np.concatenate([live, live, lb])
            node = size + np.concatenate([p, dead, pb])
            for _ in range(size.bit_length() - 1):
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def _tree(self, sym: list[int]) -> list[int]:
        """The same for one long word, with lists."""
        merges, n = self.bpe.merges, len(sym)
        size = 1 << max(1, (n - 1).bit_length())
        none = (1 << 62, 0, 0)
        leaf = lambda i, j: (merges[sym[i], sym[j]][0], i, j) if j < n and (sym[i], sym[j]) in merges else none
        tree = [none] * (2 * size)
        for i in range(n):
            tree[size + i] = leaf(i, i + 1)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i, value):
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                tree[i] = min(tree[2 * i], tree[2 * i + 1])

        while tree[1] is not none and tree[1] != none:
            _, i, j = tree[1]
            sym[i] = merges[sym[i], sym[j]][1]
            sym[j] = -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
            put(j, none)
            put(i, leaf(i, k))
            if prv[i] >= 0:
                put(prv[i], leaf(prv[i], i))
        return [s for s in sym if s >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        out: list = [None] * len(words)
        size = np.array([len(r) for r in raw])
        width = 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(int)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            if w > WIDE:
                for i in at:
                    sym = self.byte[np.frombuffer(raw[i], np.uint8)]
                    sym[-1] = self.last[raw[i][-1]]
                    out[i] = self._tree(sym.tolist())
                continue
            sym = np.full((len(at), int(w)), -1, np.int64)
            inside = np.arange(w) < size[at, None]
            sym[inside] = self.byte[np.frombuffer(b"".join(raw[i] for i in at), np.uint8)]
            sym[np.arange(len(at)), size[at] - 1] = self.last[[raw[i][-1] for i in at]]
            self._trees(sym)
            ids = sym[sym >= 0].tolist()
            ends = np.cumsum((sym >= 0).sum(axis=1)).tolist()
            for i, a, b in zip(at, [0, *ends], ends):
                out[i] = ids[a:b]
        return out

    def _parts(self, text: str) -> list[str]:
        """Words in order; special strings stand for themselves, marked by a leading blank."""
        if self.special is None or "<" not in text:
            return _words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += _words(text[at: m.start()])
            out.append(" " + m.group())
            at = m.end()
        return out + _words(text[at:])

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids, token texts) of each text, each joined by one space."""
        parts = [self._parts(t) for t in texts]
        if len(self.ids) > REMEMBER:
            self.ids.clear()
            self.texts.clear()
        new = list({w for p in parts for w in p if w not in self.ids})
        plain = [w for w in new if w[0] != " "]
        name = self.bpe.text
        for w, ids in zip(plain, self.encode_words(plain) if plain else []):
            self.ids[w] = " ".join(map(str, ids))
            self.texts[w] = " ".join([name[i] for i in ids])
        for w in new:
            if w[0] == " ":
                self.ids[w], self.texts[w] = str(self.bpe.special[w[1:]]), w[1:]
        return [(" ".join(map(self.ids.__getitem__, p)), " ".join(map(self.texts.__getitem__, p))) for p in parts]


def _plain(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # each character by itself: no special final sigma
            text = text.replace("Σ", "σ")
    return text.lower()


def _words(text: str) -> list[str]:
    text = _plain(text)
    return (_DECIMAL if decimal_only(text) else _PATTERN).findall(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(load(path))


def _encoded(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ids, decoded = [], []
            held, n = [], 0
            for text in [*batch.column("text"), None]:
                end = text is None
                if not end:
                    held.append(text.as_py() or "")
                    n += len(held[-1])
                if held and (end or n >= TOGETHER):
                    for a, b in enc.encode(held):
                        ids.append(a)
                        decoded.append(b)
                    held, n = [], 0
                    if not end and len(ids) and sum(map(len, ids)) >= 32 * TOGETHER:
                        done = len(ids)
                        yield _rows(batch.slice(0, done), ids, decoded)
                        batch, ids, decoded = batch.slice(done), [], []
            if len(ids) or not batch.num_rows:
                yield _rows(batch, ids, decoded)
    return run


def _rows(batch, ids: list[str], decoded: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array([a.count(" ") + 1 if a else 0 for a in ids], pa.int64()), pa.array(ids, pa.string()),
         pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_tokens, ids (decimal, one space apart), decoded."""
    d = pick(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_encoded(path), f"doc_id {kind}, n_tokens long, ids string, decoded string")


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded``: the token texts of the ids, one space apart."""
    ship(rows.sparkSession)
    schema = rows.select("*").schema.add("decoded", "string")

    def run(batches):
        name = load(path).text
        for batch in batches:
            out = [" ".join([name[int(i)] for i in (ids.as_py() or "").split()]) for ids in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])
    return rows.mapInArrow(run, schema)


def q_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    out = encode_texts(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op6_word_bpe": q_word_bpe}

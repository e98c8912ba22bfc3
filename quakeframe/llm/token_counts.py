"""Exact token counts by prefix dynamic programming over byte-level BPE.

A token sequence is the BPE encoding of its bytes exactly if every two neighbours are, taken
alone, what BPE makes of their joined bytes. So the encoding of each prefix of a word ends in
one token t, and what comes before t is the encoding of a shorter prefix: going left to right,
``last[i]`` is the token that fits behind ``last[i - len(t)]``, and the count at i is the count
there plus one. One pass over a word gives the exact count at *every* prefix.

A text is split into words by the tokenizer's pattern; counts of whole words add up, and a cut
inside a word or a run of white space is answered from that word's own table. So "how many
tokens has the text up to here" and "how much of the text fits a budget" need no re-encoding.
Each worker remembers the counts of words it has seen, at most ``REMEMBER`` of them.

Rows are independent: no shuffle, memory bounded by one Arrow batch and the longest text.

Edge cases: null and empty text have no bytes and no tokens; special strings in a text count as
one token, as in the tokenizers library by default; repeated rows are counted alike; null ids are
carried along; very long texts are counted whole, word by word; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.bpe_files import SPACE, BpeFile, byte_letters, decimal_only, load
from quakeframe.llm.common import pick, read

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
REMEMBER = 1_200_000  # some 150 MB
_PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
# The same for texts whose only numbers are decimal digits, where the faster engine's classes agree.
_DECIMAL = re.compile(
    rf" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?(?:\d+|(?:[^\w{SPACE}]|_)+)|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def _words(text: str) -> list[str]:
    return (_DECIMAL if decimal_only(text) else _PATTERN).findall(text)


_BLANKS = "".join(c for c in map(chr, range(0x3001)) if regex.match(f"[{SPACE}]", c))
_SHORTENED = {"'re", "'ve", "'ll"}  # cut after two characters, these are a quote and a letter


class PrefixCounter:
    def __init__(self, bpe: BpeFile):
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.bpe = bpe
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in bpe.vocab.items()}
        self.tokens = ahocorasick.Automaton()
        for i, b in self.bytes.items():
            self.tokens.add_word(b.decode("latin-1"), (len(b), i))
        self.tokens.make_automaton()
        self.special = regex.compile("|".join(map(regex.escape, sorted(bpe.special, key=len, reverse=True)))) if bpe.special else None
        self.fits: dict[int, bool] = {}
        self.known = _Counts(self)

    def merge(self, ids: list[int]) -> list[int]:
        """Plain BPE of a short sequence; only used on the bytes of one or two tokens."""
        merges = self.bpe.merges
        while len(ids) > 1:
            best = min(((merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges), default=None)
            if best is None:
                break
            (_, new), i = best
            ids = ids[:i] + [new] + ids[i + 2:]
        return ids

    def _fit(self, left: int, right: int, pair: int) -> bool:
        """Whether the two tokens stay side by side; left -1: whether ``right`` stands alone."""
        want = [right] if left < 0 else [left, right]
        raw = b"".join(self.bytes[t] for t in want)
        if len(self.fits) > 2 * REMEMBER:
            self.fits.clear()
        ok = self.fits[pair] = self.merge([self.bpe.byte_id[b] for b in raw]) == want
        return ok

    def word(self, raw: bytes) -> list[int]:
        """Token counts of raw[:0], raw[:1], ... raw[:len]."""
        known, last, count, done = self.fits.get, [-1], [0], 0
        # Every token that ends at each byte, from the automaton; one of them fits.
        for end, (size, t) in self.tokens.iter(raw.decode("latin-1")):
            if end < done:
                continue
            j = end + 1 - size
            pair = last[j] << 20 | t
            ok = known(pair)
            if ok is None:
                ok = self._fit(last[j], t, pair)
            if ok:
                last.append(t)
                count.append(count[j] + 1)
                done += 1
        return count

    def _segments(self, text: str):
        """(start, end, special?) of the parts between special strings, and of these."""
        at = 0
        if self.special is not None:
            for m in self.special.finditer(text):
                if m.start() > at:
                    yield at, m.start(), False
                yield m.start(), m.end(), True
                at = m.end()
        if at < len(text):
            yield at, len(text), False

    def total(self, text: str) -> int:
        known = self.known
        n = 0
        for a, b, special in self._segments(text):
            n += 1 if special else sum(map(known.__getitem__, _words(text[a:b])))
        if len(known) > REMEMBER:
            known.clear()
        return n

    def _chars(self, word: str) -> np.ndarray:
        """Counts of word[:1], word[:2], ... word, each encoded by itself."""
        counts = np.array(self.word(word.encode()))
        return counts[np.cumsum([len(c.encode()) for c in word])]

    def _units(self, text: str):
        """Words and special strings in order: start, end, token count, tokens before, start of
        the white-space run that the unit begins in (else its own start), tokens before that."""
        full = tail = before_tail = 0
        for a, b, special in self._segments(text):
            if special:
                yield a, b, 1, full, tail, before_tail, True
                full += 1
                tail, before_tail = b, full
                continue
            run, before_run, end_of_blank = a, full, -1
            for m in _PATTERN.finditer(text[a:b]):
                s, e, word = a + m.start(), a + m.end(), m.group()
                if s != end_of_blank:  # no white space right before
                    run, before_run = s, full
                n = self.known[word]
                yield s, e, n, full, run, before_run, False
                tail, before_tail = s, full
                full += n
                end_of_blank = e if not word.strip(_BLANKS) else -1

    def _cuts(self, text: str, unit) -> np.ndarray:
        """Token counts of the prefixes that end inside the unit or at its end."""
        s, e, n, full, run, before_run, special = unit
        if special:  # cut short it is ordinary text that joins the word before it
            cut = [before_run + self.total(text[run:p]) for p in range(s + 1, e)]
            return np.array([*cut, full + 1])
        word = text[s:e]
        out = full + self._chars(word)
        if word in _SHORTENED:
            out[1] = full + self.known["'"] + self.known[word[1]]
        blank = len(word) if not word.strip(_BLANKS) else int(word[0] in _BLANKS)
        if blank and run < s:  # up to a cut in white space its whole run is one word
            out[:blank] = before_run + self._chars(text[run: s + blank])[s - run:]
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Exact token counts of text[:0], text[:1], ... text, each encoded by itself."""
        return np.concatenate([[0], *[self._cuts(text, u) for u in self._units(text)]]).astype(np.int32)

    def fitting(self, text: str, limit: int) -> int:
        """Length of the longest prefix with at most ``limit`` tokens; only the table of the word
        where the budget ends is looked at."""
        best, over = 0, False
        for unit in self._units(text):
            s, e, n, full, run, _, _ = unit
            if over and run >= over_at:
                break
            if full + n > limit or over:
                if not over:
                    over, over_at = True, e
                cuts = self._cuts(text, unit)
                fit = np.flatnonzero(cuts <= limit)
                best = s + 1 + int(fit[-1]) if len(fit) else best
            else:
                best = e
        return best


class _Counts(dict):
    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.word(word.encode())[-1]
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(load(path))


def _counted(path: str, limit: int, table: bool):
    def run(batches):
        c = counter(path)
        for batch in batches:
            n, fit, tables = [], [], []
            for text in batch.column("text"):
                t = text.as_py() or ""
                n.append(c.total(t))
                fit.append(len(t) if n[-1] <= limit else c.fitting(t, limit))
                if table:
                    tables.append(c.prefixes(t))
            cols = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array(fit, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens", "fit_chars"]
            if table:
                cols.append(pa.array(tables, pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                 table: bool = False) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_tokens, fit_chars (length of the longest prefix with
    at most ``limit`` tokens) and, if asked for, prefix_tokens (the count of every prefix)."""
    d = pick(docs, doc_id=id_col, text=text_col)
    d = d.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, fit_chars long" + ", prefix_tokens array<int>" * table
    return d.mapInArrow(_counted(path, limit, table), schema)


def q_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars")


QUERIES = {"op2_token_counts": q_token_counts}

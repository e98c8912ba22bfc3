"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The fixed patterns find e-mail and IP addresses, card and phone numbers. The field adds what
looks like them, or like a credential, in word shape and context. It is trained on the driver
from the small labelled table of ``labelled_rows`` (a few hundred short rows made from
templates; the size is a parameter), by AdaGrad on the exact likelihood, and shipped to the
tasks as two small arrays.

Words that hold no digit, ``@`` or ``=`` can only be plain (label O) - in the table as in the
texts. A chain is cut exactly at such words, so only the runs between them are decoded: by
Viterbi, many runs side by side in numpy, padded to the next power of two. Features of a run
see one word beyond its ends. Added spans never touch a span of the fixed patterns.

Rows are independent: no shuffle, memory bounded by one Arrow batch and the longest text. Every
pattern runs in time linear in the text, also on endless runs of digits or letters.

Edge cases: null and empty text have no spans and stay as they are when redacted; repeated
rows are judged alike; null ids are carried along; very long texts and words are read whole; digits
of other scripts are letters to the fixed patterns and no octets; an empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import pick, read
from quakeframe.llm.textwords import chunks

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *KINDS)
PER_TEMPLATE = 12
FEATURES = 1 << 12
_TRIGGER = np.zeros(256, np.int64)
_TRIGGER[list(b"0123456789@=")] = 1

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Starting inside a run of digits could not match where its first digit does not.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
_FREE = re.compile("[0-9@=]")
_WORD = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    done, k = 0, text.find("@")
    while k >= 0:
        s = k
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, k + 1) if s < k else None
        if m:
            yield "email", s, m.end()
            done = m.end()
        k = text.find("@", max(k + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    out = list(_emails(text))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return _ordered(out)


def _ordered(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def shape(word: str) -> str:
    out = []
    for c in word:
        x = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != x:
            out.append(x)
    return "".join(out)


def _length(n: int) -> int:
    return n if n < 6 else 6 + (n > 8) + (n > 12) + (n > 15) + (n > 19) + (n > 31)


def _octets(core: str) -> bool:
    """Four numbers of one to three ASCII digits below 256 (other scripts' digits are none)."""
    parts = core.split(".") if core.count(".") == 3 else []
    return len(parts) == 4 and all(1 <= len(p) <= 3 and p.isascii() and p.isdecimal() and int(p) < 256 for p in parts)


def features(word: str, before: str, after: str) -> list[int]:
    """Hashed features of a word between its neighbours."""
    core = word.strip(_EDGE)
    sh = shape(core)
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    turns = len(sh)
    value = core.rpartition("=")[2].strip(_EDGE)
    number = "".join(c for c in core if "0" <= c <= "9")
    names = [
        "bias", f"luhn:{12 <= len(number) <= 19 and luhn(number)}:{len(number) > 11}",
        f"octets:{_octets(core)}", f"shape:{sh[:8]}", f"digits:{_length(digits)}", f"letters:{_length(letters)}", f"len:{_length(len(core))}",
        f"mixed:{min(turns, 8)}:{digits > 0}:{letters > 0}", f"dots:{min(core.count('.'), 4)}:{letters > 0}",
        f"at:{'@' in core}", f"equals:{'=' in core}:{_length(len(value))}", f"head:{core[:1] if not core[:1].isalnum() else shape(core[:1])}",
        f"first:{core[:4].lower() if core[:1].isalpha() else shape(core[:4])}", f"hex:{bool(value) and all(c in '0123456789abcdef' for c in value)}:{_length(len(value))}",
        f"before:{before.strip(_EDGE).lower()[:12]}", f"beforeshape:{shape(before)[:4]}", f"aftershape:{shape(after)[:4]}"]
    return [zlib.crc32(n.encode()) % (FEATURES - 1) + 1 for n in names]


# Text around a {kind} slot; other slots are numbers that are nobody's data.
TEMPLATES = (
    "write to {email} today", "contact {email}, please", "mail: {email}", "von {email} und", "à {email} pour",
    "call {phone} now", "tel. {phone} or", "phone {phone}", "the {phone2} thing", "llamar {phone} con", "fax: {phone2}.",
    "host {ip} is", "from {ip} in", "at {ip}, the", "der {ip} ist", "card {card} was", "pay with {card} in", "the {card2} of", "nummer {card2}.",
    "key {aws} is", "the {aws} in", "api_key={hex} and", "password={hex18} the", "secret={b64} de", "token = \"{hex}\" in",
    "token: {b64} and", "passwd={b64}", "aws_secret = {b64}.", "le {aws} pour", "die {hex} und", "password={hex18}", "the {hex18} of",
    "version {version}. The", "License {version} of", "in {year} the", "im Jahr {year}, als", "page {small} of {small}",
    "{price} euros for", "chapter {small}:", "see {version} and", "{small}% of", "at {time} on", "on {date} in", "since {date}.",
    "CC BY-NC {version}.", "Version {version}, June {year}", "x={small} and", "id={small}&page={small}", "a = {small}", "= {small} or",
    "the {small}th of", "{small}.", "({year})", "about {big} people", "{big} of {big}", "No. {small} in", "n={big}", "size={small}px", "@{name} said",
    "{small}x{small} m", "card {nocard} was", "the {nocard} of", "nummer {nocard}.", "host {noip} is", "from {noip} in", "a{small} road", "MP{small} player", "ISO{big}", "covid-{small}", "{small}-{small} win", "lines {small}, {small}", "© {year}")


def _value(kind: str, r: random.Random) -> str:
    pick_from = lambda s, n: "".join(r.choice(s) for _ in range(n))
    low, up, num, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    d = lambda n: pick_from(num, n)
    if kind == "email":
        return f"{pick_from(low, r.randint(3, 8))}{r.choice(['', '.', '_', '.'])}{d(r.randint(0, 2))}@{pick_from(low, 5)}{r.choice(['', d(1)])}.{r.choice(['com', 'org', 'example.com', 'net', 'de'])}"
    if kind == "ip":
        return ".".join(str(r.randint(1, 255)) for _ in range(4))
    if kind in ("phone", "phone2"):
        a, b, c = d(3), d(3), d(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"+{r.randint(10, 99)} {a} {b}{c}", f"+1-{a}-{b}-{c}", f"+{r.randint(1, 99)}{a}{b}{c}"] if kind == "phone"
                        else [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"{a}.{b}.{c}"])
    if kind in ("card", "card2"):
        n = [r.choice("3456") + d(3), d(4), d(4), d(3)]
        n[3] += next(c for c in num if luhn("".join(n) + c))
        return r.choice(["", " ", "-"] if kind == "card" else ["", ""]).join(n)
    if kind == "nocard":
        n = r.choice("123456789") + d(14)
        return n + next(c for c in num if not luhn(n + c))
    if kind == "noip":
        return ".".join(str(r.randint(1, 255)) for _ in range(3)) + "." + str(r.randint(256, 999))
    if kind == "aws":
        return "AKIA" + pick_from(up + num, 16)
    if kind in ("hex", "hex18"):
        return pick_from(hexa, 18 if kind == "hex18" else r.choice([32, 40, 64]))
    if kind == "b64":
        return pick_from(low + up + num, r.randint(20, 44)) + d(1)
    if kind == "version":
        return r.choice([f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 9)}.{r.randint(0, 12)}.{r.randint(0, 9)}"])
    if kind == "year":
        return str(r.randint(1800, 2030))
    if kind == "small":
        return str(r.randint(0, 999))
    if kind == "big":
        return r.choice([str(r.randint(1000, 999999)), f"{r.randint(1, 999)},{d(3)}", f"{r.randint(1, 999)}.{d(3)}"])
    if kind == "price":
        return r.choice(["", "$", "€"]) + f"{r.randint(1, 999)}.{d(2)}"
    if kind == "time":
        return f"{r.randint(0, 23)}:{r.randint(10, 59)}"
    if kind == "date":
        return r.choice([f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}",
                         f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}"])
    return pick_from(low, 6)


_LABEL_OF = {"email": "email", "ip": "ip", "phone": "phone", "phone2": "phone", "card": "card", "card2": "card", "aws": "secret", "hex": "secret",
             "hex18": "secret", "b64": "secret"}


def labelled_rows(per_template: int = PER_TEMPLATE, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The labelled table: (words, labels) rows."""
    r = random.Random(seed)
    rows = []
    for template in TEMPLATES:
        for _ in range(per_template if "{" in template else 1):
            words, labels = [], []
            for part in template.split():
                m = re.search(r"\{(\w+)\}", part)
                value = part if not m else re.sub(r"\{(\w+)\}", lambda x: _value(x.group(1), r), part)
                label = _LABEL_OF.get(m.group(1), "O") if m else "O"
                for w in value.split():
                    words.append(w)
                    labels.append(label if _FREE.search(w) else "O")
            rows.append((words, labels))
    return rows


def runs(words: list[str]) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of words that may carry data."""
    out, a = [], -1
    for i, w in enumerate([*words, "x"]):
        if i < len(words) and _FREE.search(w):
            a = i if a < 0 else a
        elif a >= 0:
            out.append((a, i))
            a = -1
    return out


def run_features(words: list[str], a: int, b: int) -> list[list[int]]:
    return [features(words[i], words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "") for i in range(a, b)]


class Field:
    """Emission weights by (feature, label) and transitions by (label, label)."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    @staticmethod
    def _padded(seqs: list) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(s) for s in seqs])
        out = np.zeros((len(seqs), size.max(), len(seqs[0][0])), np.int64)
        for i, s in enumerate(seqs):
            out[i, : len(s)] = s
        return out, size

    @classmethod
    def train(cls, rows: list[tuple[list[str], list[str]]], rounds: int = 150, rate: float = 0.2, ridge: float = 1e-3) -> "Field":
        seqs, gold = [], []
        for words, labels in rows:
            for a, b in runs(words):
                seqs.append(run_features(words, a, b))
                gold.append([LABELS.index(x) for x in labels[a:b]])
        x, size = cls._padded(seqs)
        n, width, _ = x.shape
        L = len(LABELS)
        inside = np.arange(width) < size[:, None]
        y = np.zeros((n, width), np.int64)
        for i, g in enumerate(gold):
            y[i, : len(g)] = g
        prev = np.concatenate([np.zeros((n, 1), np.int64), y[:, :-1]], axis=1)
        seen_w, seen_t = np.zeros((FEATURES, L)), np.zeros((L, L))
        for t in range(width):
            ok = inside[:, t]
            np.add.at(seen_w, (x[ok, t].ravel(), np.repeat(y[ok, t], x.shape[2])), 1)
            np.add.at(seen_t, (prev[ok, t], y[ok, t]), 1)
        np.add.at(seen_t, (y[np.arange(n), size - 1], 0), 1)  # a plain word follows each run
        w, s = np.zeros((FEATURES, L)), np.zeros((L, L))
        past_w, past_s = np.full(w.shape, 1e-8), np.full(s.shape, 1e-8)
        for _ in range(rounds):
            e = w[x].sum(axis=2)
            want_w, want_t = np.zeros_like(w), np.zeros_like(s)
            fwd, bwd = np.zeros((n, width, L)), np.zeros((n, width, L))
            for t in range(width):
                step = s[0] if t == 0 else _lse(fwd[:, t - 1, :, None] + s, 1)
                fwd[:, t] = np.where(inside[:, t, None], step + e[:, t], -1e9)
            for t in range(width - 1, -1, -1):
                last = (size - 1 == t)[:, None]
                follow = _lse((e[:, t + 1] + bwd[:, t + 1])[:, None, :] + s, 2) if t + 1 < width else 0
                bwd[:, t] = np.where(last, s[:, 0], follow)
            z = _lse(fwd[np.arange(n), size - 1] + s[:, 0], 1)
            for t in range(width):
                ok = inside[:, t]
                p = np.exp(fwd[ok, t] + bwd[ok, t] - z[ok, None])
                np.add.at(want_w, x[ok, t], p[:, None, :])
                if t == 0:
                    want_t[0] += p.sum(axis=0)
                else:
                    want_t += np.exp(fwd[ok, t - 1, :, None] + s + (e[ok, t] + bwd[ok, t])[:, None, :] - z[ok, None, None]).sum(axis=0)
            end = np.exp(fwd[np.arange(n), size - 1] + s[:, 0] - z[:, None]).sum(axis=0)
            want_t[:, 0] += end
            for p, past, g in ((w, past_w, seen_w - want_w - ridge * n * w / 10), (s, past_s, seen_t - want_t - ridge * n * s / 10)):
                past += g * g
                p += rate * g / np.sqrt(past)
            w[0] = 0  # index 0 pads
        return cls(w.astype(np.float32), s.astype(np.float32))

    def decode(self, seqs: list) -> list[np.ndarray]:
        """The best labels of each run."""
        out: list = [None] * len(seqs)
        size = np.array([len(s) for s in seqs])
        width = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        for v in np.unique(width):
            at = np.flatnonzero(width == v)
            for i in range(0, len(at), max(1, (1 << 16) // int(v))):
                part = at[i: i + max(1, (1 << 16) // int(v))]
                for k, labels in zip(part, self._viterbi([seqs[k] for k in part])):
                    out[k] = labels
        return out

    def _viterbi(self, seqs: list) -> list[np.ndarray]:
        x, size = self._padded(seqs)
        e = sum(self.weights[x[:, :, f]] for f in range(x.shape[2]))
        n, width, _ = e.shape
        best = self.steps[0] + e[:, 0]
        back = np.zeros((n, width, len(LABELS)), np.int8)
        for t in range(1, width):
            cand = best[:, :, None] + self.steps
            back[:, t] = cand.argmax(axis=1)
            live = (size > t)[:, None]
            best = np.where(live, cand.max(axis=1) + e[:, t], best)
        y = (best + self.steps[:, 0]).argmax(axis=1)
        out = np.zeros((n, width), np.int64)
        for t in range(width - 1, -1, -1):
            live = size > t
            out[live, t] = y[live]
            if t:
                y = np.where(live, back[np.arange(n), t, y], y)
        return [out[i, : size[i]] for i in range(n)]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _tokens(text: str):
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    return places, [text[s:e] for s, e in places]


def field_spans(text: str, places, labels_of_runs, base) -> list[tuple[str, int, int]]:
    """Spans of equally labelled neighbours, what ``base`` covers cut out of them, their outer
    punctuation off. What is left of a cut run counts if it may carry data."""
    out = []
    for (a, _), labels in labels_of_runs:
        i = 0
        while i < len(labels):
            j = i
            while j < len(labels) and labels[j] == labels[i]:
                j += 1
            if labels[i]:
                s, e = places[a + i][0], places[a + j - 1][1]
                parts, at = [], s
                for _, x, y in sorted(base, key=lambda k: k[1]):
                    if at < y and x < e:
                        parts.append((at, x))
                        at = max(at, y)
                whole = not parts
                for s, e in [*parts, (at, e)]:
                    while s < e and (text[s] in _EDGE or text[s].isspace()):
                        s += 1
                    while e > s and (text[e - 1] in _EDGE or text[e - 1].isspace()):
                        e -= 1
                    if s < e and (whole or _FREE.search(text, s, e)):
                        out.append((LABELS[labels[i]], s, e))
            i = j
    return out


def redact(text: str, spans) -> str:
    """Each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, s, e in _ordered(spans):
        if s >= at:
            out.append(text[at:s])
            out.append(f"<{kind.upper()}>")
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _found(weights: np.ndarray, steps: np.ndarray, with_text: bool):
    def run(batches):
        field = Field(weights, steps)
        for batch in batches:
            base: list = [[] for _ in range(batch.num_rows)]
            added: list = [[] for _ in range(batch.num_rows)]
            texts = batch.column("text")
            held, seqs = [], []
            for i, j, data, offs in chunks(texts):
                total = np.zeros(len(data) + 1, np.int64)
                np.cumsum(_TRIGGER[data], out=total[1:])
                for r in np.flatnonzero(total[offs[1:]] > total[offs[:-1]]):
                    text = texts[i + int(r)].as_py()
                    base[i + r] = base_spans(text)
                    places, words = _tokens(text)
                    for a, b in runs(words):
                        held.append((i + r, places, a, b))
                        seqs.append(run_features(words, a, b))
            if seqs:
                by_row: dict = {}
                for (row, places, a, b), labels in zip(held, field.decode(seqs)):
                    if labels.any():
                        by_row.setdefault(int(row), (places, []))[1].append(((a, b), labels))
                for row, (places, found) in by_row.items():
                    added[row] = field_spans(texts[row].as_py(), places, found, base[row])
            every = [_ordered(b + a) if a else b for b, a in zip(base, added)]
            cols = [batch.column("doc_id")]
            cols += [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS[:4]]
            cols += [pa.array([_joined(b) for b in base], pa.string()), pa.array([_joined(s) for s in every], pa.string())]
            names = ["doc_id", *[f"n_{k}" for k in KINDS[:4]], "base", "spans"]
            if with_text:
                out = [redact(t.as_py(), s) if s else t.as_py() for t, s in zip(texts, every)]
                cols += [batch.column(c) for c in batch.schema.names if c.startswith("keep_")] + [pa.array(out, pa.string())]
                names += [c for c in batch.schema.names if c.startswith("keep_")] + ["redacted"]
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
             keep: tuple[str, ...] = (), per_template: int = PER_TEMPLATE) -> DataFrame:
    """Per document row: doc_id, n_email, n_ip, n_card, n_phone (fixed patterns), base and spans
    (``kind:start:end``, comma-joined); with ``with_text`` also the columns of ``keep`` as
    keep_<name> and the redacted text."""
    field = Field.train(labelled_rows(per_template))
    d = pick(docs, doc_id=id_col, text=text_col, **{f"keep_{c}": c for c in keep})
    kind = {f.name: f.dataType.simpleString() for f in d.schema}
    schema = f"doc_id {kind['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    if with_text:
        schema += "".join(f", keep_{c} {kind[f'keep_{c}']}" for c in keep) + ", redacted string"
    return d.mapInArrow(_found(field.weights, field.steps, with_text), schema)


def q_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                      F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES = {"op10_pii": q_pii}

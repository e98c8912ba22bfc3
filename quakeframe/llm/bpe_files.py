"""What tokenizer files say: vocabulary, ranked merges, special strings. Loaded once per worker
from a path that is a parameter; nothing of the files is kept in the repository."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

# White space as the tokenizers library splits it; Python's own \s also takes \x1c-\x1f.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


_OTHER_NUMBER = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Nl", "No")) + "]")


def decimal_only(text: str) -> bool:
    """Whether all characters are in the basic plane and all numbers are decimal digits: then
    the standard library's \\w and \\d tell letters, numbers and the rest apart, and faster."""
    return text.isascii() or (len(text.encode("utf-16-le")) == 2 * len(text) and not _OTHER_NUMBER.search(text))


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: printable Latin-1
    bytes stand for themselves, the rest follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in own else extra))
        extra += b not in own
    return out


class BpeFile:
    """vocab: token text -> id; merges: (left id, right id) -> (rank, id); special: text -> id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            joined = a + b
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[joined])
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.text = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.byte_id = [self.vocab[c] for c in letters]
        self.last_byte_id = [self.vocab[c + self.end] for c in letters]


@lru_cache(maxsize=4)
def load(path: str) -> BpeFile:
    return BpeFile(path)

"""Words, shingles and windows of Arrow text columns as numpy arrays (runs inside tasks).

A batch is cut into chunks of whole rows of about ``CHUNK`` bytes, so that the working arrays
(some 60 bytes per byte of text) stay small; only a single text longer than that makes a larger
chunk. Hashes are 64-bit, seeded by constants, and equal on every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93, "other": 0xA0761D6478BD642F}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 1)
        both = []
        for b in (_BASE[kind], pow(_BASE[kind], -1, 2**64)):
            p = np.full(size, b, _U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        have = (both[0], both[1])
        if size <= 4 * CHUNK:
            _powers[kind] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair; equal runs hash alike at any place."""
    power, inverse = _power(kind, len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts]


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them); null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, raw[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j


class Words:
    """The words (runs of anything but ASCII white space) of a chunk's rows."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offs = offs
        n = len(data)
        solid = ~SPACE[data]
        row = np.zeros(n + 1, bool)
        row[offs] = True
        row[n] = True
        gap = np.ones(n + 1, bool)
        gap[1:] = ~solid
        before = gap[:-1].copy()  # the byte before is no word byte, or there is none
        self.starts = np.flatnonzero(solid & (before | row[:-1]))
        after = np.ones(n, bool)
        after[:-1] = ~solid[1:]
        self.ends = np.flatnonzero(solid & (after | row[1:])) + 1
        self.solid = solid
        self.row = np.searchsorted(offs, self.starts, side="right") - 1
        # Words of row r are first[r] : first[r + 1].
        self.first = np.searchsorted(self.starts, offs)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = mix(_runs(_BYTE[self.data], self.starts, self.ends, "byte"))
        return self._hash

    def windows(self, k: int, kind: str = "word") -> np.ndarray:
        """Hash of the k words from each word on; meaningful where ``whole(k)``."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, _U)
        at = np.arange(n)
        return mix(_runs(self.hash, at, at + k, kind) ^ _U(k * 0x9E37))

    def whole(self, k: int) -> np.ndarray:
        """Of the first len - k + 1 words: whether k words from there lie in one row."""
        n = len(self) - k + 1
        return self.row[:n] == self.row[k - 1:] if n > 0 else np.zeros(0, bool)

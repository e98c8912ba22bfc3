"""License scan by patience alignment of places in each text with license templates.

A text is searched in overlapping windows, somewhat longer than the template. Where a window
holds enough of the template's words, order aside (an exact bound), an alignment is laid through
each occurrence of the template's rarest words in it: equal neighbours of the anchor, then on both
sides the words that occur once in the text range and once in the template range, their longest
increasing subsequence, and the gaps the same way. Coverage is the share of the template's words
that are aligned. Every place at or above the threshold is returned, for every template.

Templates are notices and full texts (``licenses/``; read on the driver, shipped with the function).
Words that tell licenses apart can be required, or barred from a place.

Rows are independent: no shuffle. Null and empty texts match nothing; repeated rows and null ids
are judged each by its text; very long texts are searched whole, window by window; ties of
coverage go to the first template; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import math
import os
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quakeframe.llm.common import pick, read

MIN_COVERAGE = 0.8
REACH = 4  # a place may hold 1 / REACH more words than its template, and SLACK
SLACK = 8  # at each end
_FULL = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licenses")


def loaded(templates) -> list[tuple]:
    """The templates with their texts: ``file:NAME`` is NAME.txt of ``licenses/`` (driver only)."""
    out = []
    for name, text, *rest in templates:
        if text.startswith("file:"):
            with open(os.path.join(_FULL, f"{text[5:]}.txt"), encoding="utf-8") as f:
                text = f.read()
        out.append((name, text, *rest))
    return out


# Name, text, words that must be aligned, words that may not stand between the aligned ones.
_OTHER_GNU = "lesser library affero"
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0", ""),
    ("gpl-3.0", "GNU General Public License, version 3.", "3", _OTHER_GNU),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", "nc 4.0", "sa nd"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy", "", ""),
    ("mit", "Released under the MIT License.", "mit", ""),
    ("mit", "Licensed under the MIT License.", "mit", ""),
    ("apache-2.0", "Released under the Apache 2.0 license", "apache 2.0", ""),
    ("bsd-2-clause", "BSD 2-Clause License", "bsd 2 clause", ""),
    ("bsd-3-clause", "BSD 3-Clause License", "bsd 3 clause", ""),
    *((x, f"Licensed under the GNU {y} v{v}", f"{y.lower()} v{v}", "") for y, x, v in (
        ("GPL", "gpl-2.0", 2), ("GPL", "gpl-3.0", 3), ("LGPL", "lgpl-3.0", 3), ("AGPL", "agpl-3.0", 3))),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered", ""),
    ("unlicense", "Released under the Unlicense", "unlicense", ""),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost 1.0", ""),
    ("bsl-1.0", "Boost Software License - Version 1.0", "boost 1.0", ""),
    ("bsl-1.1", "Business Source License 1.1", "business 1.1", ""),
    ("epl-2.0", "Eclipse Public License v2.0", "eclipse", "1.0"),
    ("epl-2.0", "Eclipse Public License 2.0", "eclipse 2.0", ""),
    ("epl-1.0", "Eclipse Public License 1.0", "eclipse 1.0", ""),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0", "apache 2.0", ""),
    ("mit", "SPDX-License-Identifier: MIT", "mit", ""),
    ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause", "bsd 2", ""),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause", "bsd 3", ""),
    ("isc", "SPDX-License-Identifier: ISC", "isc", ""),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0", "mpl 2.0", ""),
    *((x.lower(), f"SPDX-License-Identifier: {x}", x.lower().replace("-", " "), "") for x in (
        "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0", "EPL-2.0", "BSL-1.0", "Unlicense")),
    ("gpl-2.0", "GNU General Public License, version 2.", "2", _OTHER_GNU),
    ("gpl-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "2", _OTHER_GNU),
    ("gpl-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "3", _OTHER_GNU),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1.", "lesser 2.1", ""),
    ("lgpl-2.1", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lesser 2.1", ""),
    ("lgpl-3.0", "GNU Lesser General Public License, version 3.", "lesser 3", ""),
    ("lgpl-3.0", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", "lesser 3", ""),
    ("agpl-3.0", "GNU Affero General Public License, version 3.", "affero 3", ""),
    ("agpl-3.0", "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "affero 3", ""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0", ""),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License.", "bsd 2", ""),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License.", "bsd 3", ""),
    ("isc", "Licensed under the ISC License.", "isc", ""),
    *((f"cc-{kind.lower()}-{v}", f"Licensed under CC {kind} {v}.", f"{kind.lower().replace('-', ' ')} {v}", no)
      for v in ("4.0", "3.0") for kind, no in (("BY", "nc sa nd"), ("BY-SA", "nc nd"), ("BY-ND", "nc sa"), ("BY-NC", "sa nd"),
                                               ("BY-NC-SA", "nd"), ("BY-NC-ND", "sa")) if (kind, v) != ("BY-NC", "4.0")),
    *((f"cc-{kind}-{v}", f"licensed under a Creative Commons {long} {v}", f"{long.lower().replace('-', ' ')} {v}", no)
      for v in ("4.0", "3.0") for kind, long, no in (
          ("by", "Attribution", "noncommercial sharealike noderivatives noderivs"), ("by-sa", "Attribution-ShareAlike", "noncommercial"),
          ("by-nd", "Attribution-NoDerivatives", "noncommercial"), ("by-nc", "Attribution-NonCommercial", "sharealike noderivatives noderivs"),
          ("by-nc-sa", "Attribution-NonCommercial-ShareAlike", ""), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives", ""))),
    ("cc0-1.0", "Released under CC0 1.0 Universal.", "cc0 1.0", ""),
    ("mit", "file:MIT", "", ""),
    ("isc", "file:ISC", "", ""),
    ("bsd-2-clause", "file:BSD-2-Clause", "", "endorse"),
    ("bsd-3-clause", "file:BSD-3-Clause", "endorse", ""),
    ("apache-2.0", "file:Apache-2.0", "", ""),
    ("mpl-2.0", "file:MPL-2.0", "", ""),
    ("gpl-2.0", "file:GPL-2", "", ""),
    ("gpl-3.0", "file:GPL-3", "", ""),
    ("lgpl-2.1", "file:LGPL-2.1", "", ""),
    ("lgpl-3.0", "file:LGPL-3", "", ""),
    ("cc-by-sa-4.0", "file:CC-BY-SA-4.0", "", ""),
    ("cc0-1.0", "file:CC0-1.0", "", ""),
)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def _low(text: str) -> str:
    low = text.lower()  # of the same length, so that places in it are places in the text
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def words(text: str) -> list[str]:
    return _WORD.findall(_low(text))


def align(a: list[str], b: list[str], i: int, j: int, k: int, m: int) -> list[tuple[int, int]]:
    """Matched positions of a[i:j] and b[k:m], ascending in both."""
    out, todo = [], [(i, j, k, m)]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        want = Counter(b[k:m])
        seen: dict[str, int] = {}
        for p in range(i, j):
            if a[p] in want:
                seen[a[p]] = -1 if a[p] in seen else p
        pairs = [(seen[w], q) for q, w in enumerate(b[k:m], k) if want[w] == 1 and seen.get(w, -1) >= 0]
        ends, last, back = [], [], {}
        for n, (p, _) in enumerate(pairs):  # patience piles over text places, in template order
            pile = bisect_left(ends, p)
            ends[pile:pile + 1], last[pile:pile + 1] = [p], [n]
            back[n] = last[pile - 1] if pile else -1
        n, chain = (last[-1] if last else -1), []
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        if not chain:
            continue
        chain = [(i - 1, k - 1), *reversed(chain), (j, m)]
        out += chain[1:-1]
        todo += [(p + 1, p2, q + 1, q2) for (p, q), (p2, q2) in zip(chain, chain[1:])]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, must: str = "", bars: str = ""):
        self.name, self.b = name, words(text)
        self.count = Counter(self.b)
        self.rare = sorted(self.count, key=lambda x: (-len(x), x))  # long words are rare: they tell first
        self.must, self.bars = must.split(), set(bars.split())


def _enough(have: Counter, t: Template, least: float) -> bool:
    """Whether the text's words reach ``least`` of the template's, order aside (an exact bound)."""
    spare = len(t.b) - least
    for x in t.rare:
        lost = t.count[x] - have[x]
        if lost > 0:
            spare -= lost
            if spare < 0:
                return False
    return True


def _around(a, b, lo, hi, p, q):
    """Alignment of a[lo:hi] and b that holds (p, q): equal neighbours first, the rest on both sides."""
    i, k = p, q
    while i > lo and k > 0 and a[i - 1] == b[k - 1]:
        i, k = i - 1, k - 1
    j, m = p + 1, q + 1
    while j < hi and m < len(b) and a[j] == b[m]:
        j, m = j + 1, m + 1
    return [*align(a, b, lo, i, 0, k), *((i + n, k + n) for n in range(j - i)), *align(a, b, j, hi, m, len(b))]


def _fits(a, t: Template, pairs, least: float) -> bool:
    if len(pairs) < least:
        return False
    got = Counter(t.b[q] for _, q in pairs)
    used = {p for p, _ in pairs}
    return all(got[x] for x in t.must) and not any(a[p] in t.bars for p in range(pairs[0][0], pairs[-1][0]) if p not in used)


def regions(a: list[str], t: Template, threshold: float) -> list[tuple[int, int, int]]:
    """(matched words, first, behind the last word) of each place of ``t`` in ``a``, in order and
    apart. Of places that overlap, the one around the first anchor with the best coverage counts."""
    b, out, s = t.b, [], 0
    least = threshold * len(b) - 1e-9
    reach = len(b) + len(b) // REACH + 2 * SLACK
    width = reach + reach // 2
    full = Counter(a[:width])
    while s < len(a):
        if _enough(full, t, least):
            place: dict[str, list[int]] = {}
            for p in range(s, min(len(a), s + width)):
                if a[p] in t.count:
                    place.setdefault(a[p], []).append(p)
            spots = sorted((len(place[x]), q) for q, x in enumerate(b) if x in place)
            tries = len(b) - math.ceil(least) + 1  # of so many words, one is aligned in any place
            best = None
            for _, q in spots[:tries]:
                for p in place[b[q]]:
                    for left, right in ((1, 1), (q // REACH + SLACK, (len(b) - q) // REACH + SLACK)):  # tight, then wide
                        pairs = _around(a, b, max(s, p - q - left), min(len(a), p + len(b) - q + right), p, q)
                        if _fits(a, t, pairs, least):
                            key = (-len(pairs), pairs[-1][0] - pairs[0][0], pairs[0][0])
                            if best is None or key < best:
                                best = key
                if best is not None:
                    break
            if best is not None:
                out.append((-best[0], best[2], best[2] + best[1] + 1))
                # Another place may lie before this one.
                out += [(n, s + x, s + y) for n, x, y in regions(a[s:best[2]], t, threshold)]
                s = best[2] + best[1] + 1
                full = Counter(a[s: s + width])
                continue
        step = max(1, width - reach)
        full.subtract(a[s: s + step])
        full.update(a[s + width: s + width + step])
        s += step
    return sorted(out, key=lambda r: r[1])


def _scanned(templates, threshold: float):
    def run(batches):
        ready = [Template(*t) for t in templates]
        for batch in batches:
            names, covers, every = [], [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                w = words(text)
                have, best, found = Counter(w), (0.0, None), []
                for t in ready:
                    least = threshold * len(t.b) - 1e-9
                    if t.b and len(w) >= least and _enough(have, t, least):
                        found += [(n / len(t.b), s, e, t.name) for n, s, e in regions(w, t, threshold)]
                for c, _, _, name in found:
                    if c > best[0]:
                        best = (c, name)
                names.append(best[1])
                covers.append(best[0])
                if found:
                    at = [m.span() for m in _WORD.finditer(_low(text))]
                    found = [{"license": name, "coverage": c, "start": at[s][0], "end": at[e - 1][1]}
                             for c, s, e, name in sorted(found, key=lambda f: (f[1], -f[2], f[3], -f[0]))]
                every.append(found)
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(covers, pa.float64()), pa.array(every, kind)],
                ["doc_id", "license", "coverage", "licenses"])
    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
                  threshold: float = MIN_COVERAGE) -> DataFrame:
    """Per document row: doc_id, license (best covered template, else null), coverage, and
    licenses: every place of every template at or above the threshold, with its coverage and span of
    characters. ``templates``: name, text[, words that must match[, words that may not
    stand between]]."""
    d = pick(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_scanned(loaded(templates), threshold), f"doc_id {kind}, license string, coverage double, "
                          "licenses array<struct<license: string, coverage: double, start: long, end: long>>")


def q_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


QUERIES = {"op3_license_scan": q_license_scan}

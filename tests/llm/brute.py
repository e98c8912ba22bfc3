"""Plain-Python versions of the operators, for small inputs."""

import collections
import hashlib
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminated(docs, items, window=13):
    """{(doc_id, text): (n_words, n_hit, n_items, items)}"""
    wins = []
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(UPPER))
        k = min(window, len(w))
        wins += [(item, k, tuple(w[i:i + k])) for i in range(len(w) - k + 1)] if w else []
    out = {}
    for doc, text in docs:
        w = BENCH_WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for item, k, win in wins:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) == win:
                    hit.update(range(i, i + k))
                    if item is not None:
                        found.add(str(item))
        out[doc, text] = (len(w), len(hit), len(found), ",".join(sorted(found)))
    return out


def shingles(text, k=5):
    w = SPACE_WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(docs, percent=85, k=5):
    """[(doc_id, n_shingles, component_id)] in order, for unique ids."""
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        least[find(i)].append(doc)
    return [(doc, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (doc, _) in enumerate(docs)]


def cut(texts, window=35):
    """[(n_words, n_removed, kept)]"""
    words = [SPACE_WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def fixed_counts(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {p for i in range(len(w) - 7) if wins[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again)

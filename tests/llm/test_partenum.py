"""N-gram Jaccard join: against all pairs, and the promise of its signatures."""

import random
from itertools import combinations

import numpy as np
import pytest

from quakeframe.llm import partenum_join as P
from tests.llm import brute
from tests.llm.test_pairs import _docs


def _links(rows, percent=90):
    sets = {d: brute.shingles(t, 3) for d, t in rows}
    return {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2)
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def test_components(frame, words, odd):
    rows = _docs(words, odd)
    got = {r.doc_id: r for r in P.similar_documents(frame(rows)).collect()}
    assert len(got) == len(rows)
    for doc, n, component in brute.components(rows, 90, 3):
        assert (got[doc].n_shingles, got[doc].component_id) == (n, component), doc


@pytest.mark.parametrize("percent", [75, 90, 100])
def test_all_links(frame, words, odd, percent):
    rows = _docs(words, odd)
    members, links = P.linked_classes(frame(rows), percent=percent)
    members = members.collect()
    assert len(members) == len(rows)
    docs = {}
    for r in members:
        docs.setdefault(r["class"], []).append(r.doc_id)
    got = {tuple(sorted(p)): r.n_same for r in links.collect() for p in ((x, y) for x in docs[r.a] for y in docs[r.b])}
    n = {r.doc_id: r.n_shingles for r in members}
    got |= {p: n[p[0]] for c, same in docs.items() if c is not None for p in combinations(sorted(same), 2)}
    assert got == _links(rows, percent)


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_similar_sets_share_a_signature(percent):
    r = np.random.default_rng(percent)
    for _ in range(400):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        most = int((100 - percent) * len(a) / 100) + 1
        gone, new = int(r.integers(0, most + 1)), int(r.integers(0, most + 1))
        b = np.union1d(r.permutation(a)[gone:], r.integers(0, 2**64, new, dtype=np.uint64))
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= percent * (len(a) + len(b) - same):
            assert np.intersect1d(P.signatures(a, percent), P.signatures(b, percent)).size
            apart = sum(bin(int(x)).count("1") for x in (P.sketch(a) ^ P.sketch(b)).view(np.uint64))
            assert (100 + percent) * apart <= (100 - percent) * (len(a) + len(b))


def test_bands_hold_partners_in_two():
    for percent in (50, 80, 90, 99):
        for n in range(1, 3000):
            i, high = P.band(n, percent)
            assert high >= n and P.band(n * 100 // percent, percent)[0] <= i + 1


def test_repeated_and_null_ids(frame, words):
    a, b = words(100, 1), words(100, 2)
    rows = [(7, a), (7, a), (7, b), (None, a), (None, words(90, 3)), (9, b), (9, None), (None, None)]
    out = P.similar_documents(frame(rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles > 0) for r in out) == sorted(
        [(7, 7, True), (7, 7, True), (7, 7, True), (0, 7, True), (0, 0, True), (9, 7, True), (9, 9, False), (0, 0, False)])


def test_empty(frame):
    empty = frame([]).limit(0)
    assert P.similar_documents(empty).count() == 0
    members, links = P.linked_classes(empty)
    assert members.count() == 0 and links.count() == 0


def test_copies_with_edits_of_their_own_are_not_paired(spark, frame, words, monkeypatch):
    """Members of a group that hangs together by a star are not paired with one another."""
    rows = [(i, words(60, 5) + f" tail{i}") for i in range(300)]
    checked = []
    confirmed = P._Join.confirmed
    monkeypatch.setattr(P._Join, "confirmed", lambda self, pairs: checked.append(pairs.count()) or confirmed(self, pairs))
    assert {r.component_id for r in P.similar_documents(frame(rows)).collect()} == {0}
    assert sum(checked) < 4 * len(rows)


def test_recombined_paragraphs_make_few_pairs(frame, words, monkeypatch):
    """Documents of 11 out of 14 shared paragraphs share many signatures and hardly a link: the
    bounds leave few pairs to confirm."""
    paragraphs = [words(30, 40 + i, 500) for i in range(14)]
    r = random.Random(5)
    rows = [(i, "\n".join(paragraphs[p] for p in sorted(r.sample(range(14), 11)))) for i in range(200)]
    checked = []
    confirmed = P._Join.confirmed
    monkeypatch.setattr(P._Join, "confirmed", lambda self, pairs: checked.append(pairs.count()) or confirmed(self, pairs))
    got = {x.doc_id: x.component_id for x in P.similar_documents(frame(rows)).collect()}
    assert got == {d: c for d, _, c in brute.components(rows, 90, 3)}
    assert sum(checked) < 2 * len(rows)

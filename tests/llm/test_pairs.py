"""Decontamination, near duplicates, repeated passages: against brute force."""

import random

import pytest

from quakeframe.llm import decontaminate as D
from quakeframe.llm import minhash_dedup as M
from quakeframe.llm import substring_dedup as S
from tests.llm import brute


def _docs(words, odd):
    r = random.Random(4)
    rows = list(enumerate(odd))
    base = words(200, 50).split()
    for i in range(60):  # near copies at all distances, around a base that is there too
        w = list(base)
        for _ in range(i // 3):
            w[r.randrange(len(w))] = f"edit{r.random()}"
        rows.append((100 + i, " ".join(w)))
    passage = words(60, 51)
    rows += [(300 + i, words(40, 60 + i) + " " + passage + " " + words(30, 90 + i)) for i in range(25)]
    rows += [(400 + i, words(r.randint(1, 50), 200 + i, 3)) for i in range(40)]
    return rows


def test_near_duplicates(frame, words, odd):
    rows = _docs(words, odd)
    got = {r.doc_id: r for r in M.near_duplicates(frame(rows)).collect()}
    assert len(got) == len(rows)
    for doc, n, component in brute.components(rows):
        assert (got[doc].n_shingles, got[doc].component_id, got[doc].kept) == (n, component, doc == component), doc


def test_near_duplicates_repeated_and_null_ids(frame, words):
    a, b = words(100, 1), words(100, 2)
    rows = [(7, a), (7, a), (7, b), (None, a), (None, words(90, 3)), (9, b), (9, None)]
    out = M.near_duplicates(frame(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0) for r in out) == sorted(
        [(False, 7, 7), (False, 7, 7), (False, 7, 7), (True, 0, 7), (True, 0, 0), (False, 9, 7), (False, 9, 9)])
    assert sum(r.first for r in out if r.n_shingles) == 4  # both rows of (7, a), one of b, the lone null


def test_many_copies_make_few_pairs(spark, frame, words):
    rows = [(i, words(60, 5) + f" tail{i}") for i in range(300)]
    out = M.near_duplicates(frame(rows))
    assert {r.component_id for r in out.collect()} == {0}


@pytest.mark.parametrize("table", ["near", "cut", "clean"])
def test_empty_tables(frame, table):
    empty = frame([]).limit(0)
    out = {"near": lambda: M.near_duplicates(empty), "cut": lambda: S.cut_repeats(empty),
           "clean": lambda: D.decontaminate(empty, empty.select(empty.doc_id.alias("item_id"), "text"))}[table]()
    assert out.count() == 0


def test_cut_repeats(frame, words, odd):
    rows = _docs(words, odd)
    r = random.Random(1)
    for k in range(30):  # passages of every length around the window, at every offset
        p = words(30 + k % 12, 700 + k)
        rows += [(1000 + 2 * k, words(r.randint(0, 50), 800 + k) + " " + p + " " + words(9, k)),
                 (1001 + 2 * k, words(r.randint(0, 50), 900 + k) + "\n" + p)]
    got = {r.doc_id: r for r in S.cut_repeats(frame(rows)).collect()}
    for (doc, _), (n, removed, kept) in zip(rows, brute.cut([t for _, t in rows])):
        assert (got[doc].n_words, got[doc].n_removed, got[doc].kept, got[doc].kept_sha256) == (n, removed, kept, brute.sha(kept)), doc


def test_cut_repeats_repeated_and_null_ids(frame, words):
    a, b = words(80, 1), words(80, 2)
    rows = [(1, a), (1, a), (1, b), (None, b), (None, words(70, 3)), (2, None)]
    want = sorted((t or "", *x) for (_, t), x in zip(rows, brute.cut([t for _, t in rows])))
    got = S.cut_repeats(frame(rows)).collect()
    assert sorted((r.n_words, r.n_removed, r.kept) for r in got) == sorted(x[1:] for x in want)


def test_cut_repeats_flushes(frame, words, odd, monkeypatch):
    rows = _docs(words, odd)
    monkeypatch.setattr(S, "FLUSH", 50)
    want = {doc: x for (doc, _), x in zip(rows, brute.cut([t for _, t in rows]))}
    df = frame(rows).coalesce(1)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in S.cut_repeats(df).collect()} == want


def test_every_difference_is_covered():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))
    with pytest.raises(ValueError):
        S.cut_repeats(None, cover=(0, 1))


@pytest.mark.parametrize("broadcast", [D.BROADCAST_ROWS, 0])
def test_decontaminate(spark, frame, words, odd, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast)  # 0: the shuffled join
    items = [(1, words(40, 1)), (2, words(12, 2)), (2, words(30, 3)), (30, "one"), (4, "w1 w2"), (5, None), (6, " .. "), (None, words(20, 8)),
             (8, words(40, 1)), (9, "the of the of the of the of the of the of the of the")]
    rows = _docs(words, odd)
    r = random.Random(3)
    for k in range(40):
        w = items[k % 3][1].split()
        a = r.randrange(len(w))
        rows.append((2000 + k, words(r.randint(0, 30), k) + " " + " ".join(w[a: a + r.randint(5, 30)]).upper() + ", " + words(5, k + 1)))
    rows += [(3000, words(20, 8)), (3000, words(40, 1)), (None, words(40, 1)), (3001, "the of " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for x in D.decontaminate(frame(rows), bench).collect():
        got[x.doc_id, x.n_words, x.n_hit, x.n_items, ",".join(x.item_ids), x.contaminated] = True
    want = {(d, *v, v[1] > 0 and 20 * v[1] >= v[0]): True for (d, t), v in brute.decontaminated(rows, items).items()}
    assert got == want
    assert D.decontaminate(frame(rows), bench.limit(0)).filter("n_hit > 0 or contaminated").count() == 0


@pytest.mark.parametrize("n", [20, 80])
def test_repeated_rows_make_hits_in_proportion(spark, frame, words, monkeypatch, n):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame([(1, words(40, 1))], "item_id long, text string")
    rows = [(7, words(40, 1))] * n + [(8, words(40, 1))]
    d = frame(rows).select("doc_id", "text")
    assert D.hits(d, bench).count() <= 2 * 28  # of the two distinct rows, however often they repeat
    out = D.decontaminate(frame(rows), bench).collect()
    assert len(out) == n + 1 and all(r.contaminated and r.n_hit == 40 for r in out)

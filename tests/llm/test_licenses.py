import random

import pytest

from quakeframe.llm import license_scan as L


def test_alignment_is_increasing_and_covers():
    r = random.Random(1)
    for _ in range(300):
        a = [r.choice("abcdefgh") for _ in range(r.randint(0, 12))]
        b = [r.choice("abcdefgh") for _ in range(r.randint(0, 8))]
        m = L.align(a, b, 0, len(a), 0, len(b))
        assert all(a[p] == b[q] for p, q in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))
        whole = L.align(a + b, b, 0, len(a) + len(b), 0, len(b))
        assert len(whole) <= len(b)


def test_scan(frame, odd):
    texts = odd + ["x\nLicensed under the Apache License, Version 2.0.\ny", "version 3. of the law"]
    got = {r.doc_id: (r.license, r.coverage) for r in L.scan_licenses(frame(list(enumerate(texts)))).collect()}
    assert got[len(odd)] == ("apache-2.0", 1.0) and got[len(odd) + 1][0] is None and got[0] == (None, 0.0)
    assert L.scan_licenses(frame([])).count() == 0


@pytest.mark.parametrize("n", range(len(L.TEMPLATES)))
def test_every_template_is_found(n):
    template = L.loaded(L.TEMPLATES)[n]
    name, text = template[:2]
    r = random.Random(n)
    around = [" ".join(r.choice("the of and work thing license public".split()) for _ in range(300)) for _ in range(2)]
    got = L.regions(L.words(f"{around[0]}\n{text}\n{around[1]}"), L.Template(*template), L.MIN_COVERAGE)
    size = len(L.words(text))
    assert name and got == [(size, 300, 300 + size)]


def _scan(frame, texts):
    return {r.doc_id: r for r in L.scan_licenses(frame(list(enumerate(texts)))).collect()}


def test_names_that_differ_in_a_word(frame):
    lines = {"Released under the MIT License.": {"mit"}, "Released under the Apache License.": set(), "Licensed under CC BY-NC-SA 4.0.": {"cc-by-nc-sa-4.0"},
             "Licensed under CC BY 4.0.": {"cc-by-4.0"}, "GNU Lesser General Public License, version 3.": {"lgpl-3.0"},
             "GNU General Public License, version 2.": {"gpl-2.0"}, "Released under the Apache 2.0 license": {"apache-2.0"},
             "BSD 3-Clause License": {"bsd-3-clause"}, "Licensed under the GNU AGPL v3": {"agpl-3.0"}, "Released under the Unlicense": {"unlicense"},
             "Eclipse Public License v2.0": {"epl-2.0"}, "Distributed under the Boost Software License, Version 1.0.": {"bsl-1.0"}}
    got = _scan(frame, [f"x y z {t} a b c" for t in lines])
    for i, (t, want) in enumerate(lines.items()):
        assert {x.license for x in got[i].licenses} == want, t
        assert (got[i].license in want) if want else got[i].license is None


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for k, y in enumerate(b):
            row[k + 1] = old[k] + 1 if x == y else max(old[k + 1], row[k])
    return row[-1]


def test_repeated_notices_against_brute_force():
    r = random.Random(8)
    for name, text, *rest in L.loaded(L.TEMPLATES):
        t = L.Template(name, text, *rest)
        if len(t.b) > 250:
            continue
        for gap in (0, 1, 40, 2000):
            a, planted = [], []
            for _ in range(4):
                a += [r.choice("alpha beta gamma of the a to version".split()) for _ in range(gap)]
                part = list(t.b)
                if len(part) > 12:
                    free = [q for q, x in enumerate(part) if x not in t.must and 0 < q < len(part) - 1]
                    del part[r.choice(free)]
                planted.append((_lcs(part, t.b), len(a), len(a) + len(part)))
                a += part
            got = L.regions(a, t, L.MIN_COVERAGE)
            if gap > 1:
                assert [n for n, _, _ in got] == [n for n, _, _ in planted], (name, gap)
                assert all(abs(g[1] - p[1]) <= L.SLACK and abs(g[2] - p[2]) <= L.SLACK for g, p in zip(got, planted)), (name, gap)
            assert len(got) == len(planted) and all(n >= L.MIN_COVERAGE * len(t.b) for n, _, _ in got), (name, gap)


def test_all_licenses_of_a_text(frame):
    apache, nc = "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."
    text = f"İ été {apache} some words between them {nc} and {apache}"
    got = _scan(frame, [text, apache, "nothing", None])
    places = [(x.license, x.coverage, text[x.start:x.end]) for x in got[0].licenses]
    assert places == [("apache-2.0", 1.0, apache[:-1]), ("cc-by-nc-4.0", 1.0, nc[:-1]), ("apache-2.0", 1.0, apache[:-1])]
    assert got[0].license == "apache-2.0" and got[2].licenses == [] == got[3].licenses and len(got[1].licenses) == 1


def test_loose_words_before_a_place_hide_nothing():
    """A full text that lost 28 of its once-only words, which stand loosely before it: every one of
    these is tried as an anchor in vain before one is that the place has."""
    t = next(L.Template(*x) for x in L.loaded(L.TEMPLATES) if x[:1] == ("mit",) and len(L.words(x[1])) > 100)
    once = [x for x in t.rare if t.count[x] == 1]
    for lost in (10, 28, len(t.b) // 5):
        gone = once[:lost]
        place = [f"other{i}" if x in gone else x for i, x in enumerate(t.b)]
        covered = (len(t.b) - len(gone)) / len(t.b)
        a = [*gone, *["filler"] * 60, *place]
        got = L.regions(a, t, L.MIN_COVERAGE)
        assert (len(got) == 1 and got[0][0] >= len(t.b) - len(gone)) if covered >= L.MIN_COVERAGE else not got, lost


def test_full_texts_with_scattered_losses_against_brute_force():
    r = random.Random(3)
    for x in L.loaded(L.TEMPLATES):
        t = L.Template(*x)
        if not 100 < len(t.b) < 700:
            continue
        for share in (0.05, 0.12, 0.17, 0.3):
            keep = [w if w in t.must or r.random() > share else f"z{i}" for i, w in enumerate(t.b)]
            a = ["alpha"] * 30 + keep + ["beta"] * 30
            got = L.regions(a, t, L.MIN_COVERAGE)
            best = _lcs(keep, t.b)
            if best >= 1.05 * L.MIN_COVERAGE * len(t.b):
                assert len(got) == 1 and got[0][0] >= 0.97 * best, (t.name, share)
            elif best < L.MIN_COVERAGE * len(t.b):
                assert not got, (t.name, share)


def test_repeated_rows_and_null_ids(frame):
    line = "Released under the MIT License."
    out = L.scan_licenses(frame([(1, line), (1, line), (None, line), (None, None), (2, "no license here")])).collect()
    assert sorted((str(r.doc_id), str(r.license), len({x.license for x in r.licenses})) for r in out) == sorted(
        [("1", "mit", 1), ("1", "mit", 1), ("None", "mit", 1), ("None", "None", 0), ("2", "None", 0)])

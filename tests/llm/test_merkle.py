"""Merkle manifest: against a plain tree that hashes everything anew."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quakeframe.llm import merkle_manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos string, leaf string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    parts = [row[0], row[1], row[2], row[3], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts])


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        d = levels[-1]
        levels.append([H(*d[i:i + 8]) for i in range(0, len(d), 8)])
    return levels


def _brute(rows):
    """Sorted result rows of (doc_id, source, lang, n_chars, text) rows."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, members = [], []
    for lang in langs:
        have = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[4])))
        members.append(have)
        trees.append(_tree([_leaf(r, r[4]) for r in have]))
    top = _tree([t[-1][0] for t in trees])
    root = top[-1][0]
    out = []
    for g, (have, tree) in enumerate(zip(members, trees)):
        for i, r in enumerate(have):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            cur, proof = _leaf(r, r[4].translate(low) if tampered else r[4]), ""
            for levels, at in ((tree, i), (top, g)):
                for d in levels[:-1]:
                    run = d[at // 8 * 8: at // 8 * 8 + 8]
                    proof += "".join(run[:at % 8] + run[at % 8 + 1:])
                    cur = H(*run[:at % 8], cur, *run[at % 8 + 1:])
                    at //= 8
            out.append((r[0], tree[0][i], tree[-1][0], root, H(proof), cur, cur == root))
    return sorted(out, key=str)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], SCHEMA)


def _got(spark, rows):
    docs = _frame(spark, rows)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = M.manifest(docs, changed={"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, low).otherwise(F.col("text"))})
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("levels", [4, 1, 2])
def test_manifest(spark, odd, monkeypatch, levels):
    """Blocks of 8 and of 64 nodes make several stages of the same trees."""
    monkeypatch.setattr(M, "LEVELS", levels)
    rows = [(i, "s", "en", len(t) if t is not None else None, t) for i, t in enumerate(odd)]
    rows += [(100 + i, None if i % 7 == 0 else "web", ["de", "en", None, "é", "z"][i % 5 if i % 2 else 1], i, f"Text {i}") for i in range(700)]
    rows += [(5000, "s", "lone", 3, "ABC"), (5001, "s", "", 3, "abc")]
    rows += [(None, "s", "de", 1, "X"), (None, "s", "de", 1, "Y"), (100, "s", "en", 0, "another"), rows[30], rows[30]]
    assert _got(spark, rows) == _brute(rows)


def test_each_row_a_group(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 1)
    rows = [(i, "s", f"lang{i}", i, f"Text {i}") for i in range(600)]
    assert _got(spark, rows) == _brute(rows)


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_small_trees(spark, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert _got(spark, rows) == _brute(rows)


def test_untampered_is_verified_and_empty(spark, odd):
    rows = [(i, "s", "en", 1, t) for i, t in enumerate(odd)]
    assert all(r.verified for r in M.manifest(_frame(spark, rows)).collect())
    assert _got(spark, []) == []


def test_other_fields_and_groups(spark):
    docs = spark.createDataFrame([(f"k{i}", i % 3, float(i)) for i in range(50)], "name string, part int, size double")
    out = M.manifest(docs, "name", "part", ("name", "size")).collect()
    assert len(out) == 50 and {r.leaf for r in out} == {H(f"{len(r.name)}:{r.name}", f"{len(str(float(r.name[1:])))}:{float(r.name[1:])}") for r in out}
    assert len({r.subroot for r in out}) == 3 and len({r.root for r in out}) == 1 and all(r.verified for r in out)

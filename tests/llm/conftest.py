import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def words():
    """Random text of a few syllables."""
    def make(n, seed, vocabulary=60):
        r = random.Random(seed)
        return " ".join(r.choice("the of and Straße été niño X-1 Éa".split() + [f"w{i}" for i in range(vocabulary)]) for _ in range(n))
    return make


@pytest.fixture()
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns named like the operators' own."""
    def make(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)
        clash = {c: F.lit("mine") for c in ("ref", "th", "key", "h", "n_words", "kept", "shard", "token", "pos", "spans", "score", "rule")}
        return df.withColumns(clash)
    return make


@pytest.fixture()
def odd(words):
    """Texts that try the edges: null, empty, blank, short, very long, equal, long runs."""
    long = words(6000, 9)
    return [None, "", " \n\t ", "one", "a b c d", words(300, 1), words(300, 1), words(300, 1).upper(), long, long + " end",
            "x" * 50_000, "7" * 30_000, "a b c d e f g h " * 30, "\x00 \x1c \x85   　", "é" * 3000 + " ß " + "𝔘 " * 50, "@" * 500 + "." * 500]

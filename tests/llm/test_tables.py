"""URL filter, sharding, pipeline and the registered queries."""

import random
import zlib

import pytest

import corpus_pipeline
from quakeframe import llm
from quakeframe.llm import sharding, url_filter
from tests.conftest import SF_SMALL

URLS = [None, "", "nothing", "http://", "://", "http://net", "http://net/", "HTTP://A.NET/x", "https://example.net/en/a", "https://b.Example.net/en/",
        "https://example.net/en", "https://xexample.net/en/", "http://example.com/de/1", "http://example.com/DE/1", "http://a.org/fr/", "http://org/fr/?q",
        "http://a.org?x=/fr/", "http://spam-farm.example.org/en/", "http://www.cheap-pills.example.com/", "http://spam-farmer.example.org/", "http://u@net:80/",
        "x://y://net/", "http://a.net#/", "http://casino", "http://a.b/casino", "http://casino:8080/x", "http://a\n.net/"]


def _judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = max(((len(h + p), h + p, a) for a, h, p in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    if best:
        return host, path, best[1], best[2]
    labels = host.rpartition(":")[0].split(".") if ":" in host else host.split(".")
    return host, path, None, "block" if any(x in labels for _, x in url_filter.LABEL_RULES) else "allow"


@pytest.mark.parametrize("small", [url_filter.BROADCAST_RULES, 0])
def test_judge_urls(spark, monkeypatch, small):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", small)
    rows = [(i, u, "<p>", "mine") for i, u in enumerate(URLS)] + [(None, URLS[6], "", ""), (6, URLS[6], "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(url_filter.default_rules(), url_filter.RULE_TYPE)
    got = url_filter.judge_urls(pages, rules).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(r[0], *_judge(r[1]))).replace("Row(", "Row(", 1) for r in rows) or sorted(
        (str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted((str(r[0]), *map(str, _judge(r[1]))) for r in rows)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_rule_without_literal(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x9"), (2, "http://a.example/x")], "page_id long, url string")
    rules = spark.createDataFrame([("digit", "block", "[0-9]$", 5, [], True)], url_filter.RULE_TYPE)
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules).collect()} == {1: "block", 2: "allow"}


def test_difference_is_tight():
    r = random.Random(1)
    parts = [[r.randint(1, 10_000)] + [0] * 7 for _ in range(500)]
    sums, place = sharding.difference(parts, 8)
    check = [0] * 8
    for p, to in zip(parts, place):
        for value, s in zip(p, to):
            check[s] += value
    assert check == sums and max(sums) - min(sums) <= 20


@pytest.mark.parametrize("leaf", [sharding.LEAF, 7])
def test_shard_documents(spark, frame, words, odd, monkeypatch, leaf):
    monkeypatch.setattr(sharding, "LEAF", leaf)
    monkeypatch.setattr(sharding, "FANOUT", 3)
    rows = list(enumerate(odd)) + [(100 + i, words(random.Random(i).randint(1, 400), i)) for i in range(400)]
    rows += [(900 + i, "equal text") for i in range(50)] + [(None, "equal text"), (5, odd[5])]
    got = sharding.shard_documents(frame(rows), shards=4).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    by_text, load = {}, [0] * 4
    for r in got:
        t = "equal text" if r.doc_id is None else text[r.doc_id]
        raw = (t or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert by_text.setdefault(t, r.shard) == r.shard
        load[r.shard] += r.size
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert max(load) - min(load) <= (0.02 if leaf > 7 else 0.1) * sum(load)  # tiny leaves hold texts of a third of a shard
    assert sharding.shard_documents(frame([])).count() == 0


def test_pipeline(spark):
    from pyspark.sql import functions as F
    from quakeframe.llm import decontaminate, minhash_dedup, pii, quality, word_bpe
    import public_tokenizers

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    want = docs.join(quality.judge_quality(docs).filter("kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns).checkpoint()
    want = want.join(minhash_dedup.near_duplicates(want).filter("kept").select("doc_id"), "doc_id", "left_semi").checkpoint()
    want = want.join(decontaminate.decontaminate(want, bench).filter("not contaminated").select("doc_id"), "doc_id", "left_semi").checkpoint()
    assert 0 < want.count() < docs.count()
    want = pii.find_pii(want, with_text=True).select("doc_id", F.col("redacted").alias("text"))
    want = word_bpe.encode_texts(want, public_tokenizers.path(word_bpe.VOCABULARY))
    assert sorted(corpus_pipeline.run(spark, SF_SMALL).collect()) == sorted(want.collect())


def test_pipeline_edges(spark, tmp_path, words, odd):
    """Nulls, repeated rows and ids, an extra column, and empty tables pass through every stage."""
    rows = [(i, t, None, "s", 1, "extra") for i, t in enumerate(odd + [words(80, i) for i in range(40)])]
    rows += [(30, rows[30][1], None, "s", 1, "extra"), (None, words(90, 77), "en", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, th string"
    for name, some in (("full", rows), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, words(20, 5))] if some else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for k, (step, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, d).write.parquet(f"{d}/{k}")
            docs = spark.read.parquet(f"{d}/{k}")
            if step != "tokens":
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        ids = [r.doc_id for r in docs.collect()]
        assert len(ids) == len(set(ids)) and (not some or (None in ids and 30 in ids))


def test_registered():
    names = [k.split("_")[0] for k in llm.QUERIES]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14)) and set(llm.ORACLE) <= set(llm.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5

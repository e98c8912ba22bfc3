"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

1. quality - documents that the quality rules reject go;
2. near_duplicates - one document of each group of near duplicates stays (the smallest id);
3. decontamination - documents contaminated by a benchmark item go;
4. personal_data - personal data and credentials are replaced by their kind, n_chars follows;
5. tokens - the texts as token ids of the word BPE, with the decoded text.

Each stage works on all that its predecessor kept and returns the columns of ``documents``, the
last one doc_id, n_tokens, ids and decoded. Rows keep every other column as it was. Texts that
are null are rejected by the first stage (no words); a null id is kept as it is; rows that share
an id are judged each on its own text; empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import read
from quakeframe.llm.decontaminate import decontaminate
from quakeframe.llm.minhash_dedup import near_duplicates
from quakeframe.llm.pii import find_pii
from quakeframe.llm.quality import judge_quality
from quakeframe.llm.word_bpe import VOCABULARY, encode_texts
from quakeframe.session import shared_dir


def _kept(docs: DataFrame, verdicts: DataFrame, keep) -> DataFrame:
    """The rows of ``docs`` whose verdict (doc_id, th and the columns of ``keep``) is to stay."""
    good = verdicts.filter(keep).select(F.col("doc_id").alias("vid"), F.col("th").alias("vth")).distinct()
    # Only ids and text hashes are compared; the texts travel once.
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col("vid")) & (F.xxhash64("text") == F.col("vth")), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, judge_quality(docs), F.col("kept"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = _kept(docs, near_duplicates(docs), F.col("first"))
    ids = docs.select("doc_id", F.xxhash64("text").alias("th")).groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1").isEmpty():
        return out
    return out.dropDuplicates(["doc_id", "text"])  # rows repeated with their id


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, decontaminate(docs, read(spark, sf_dir, "benchmark")), ~F.col("contaminated"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = find_pii(docs, with_text=True, keep=others)
    text = {"doc_id": F.col("doc_id"), "text": F.col("redacted")}
    size = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return out.select(*[text[c].alias(c) if c in text else F.char_length("redacted").cast(size).alias(c) if c == "n_chars"
                        else F.col(f"keep_{c}").alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", quality), ("near_duplicates", dedup), ("decontamination", decontamination),
          ("personal_data", personal_data), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


ORACLE_SQL = None  # the language model and the random field are not SQL; tested by brute force
QUERIES = {"pipeline": run}
ORACLE: dict = {}

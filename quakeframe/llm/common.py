"""Helpers shared by the text-corpus operators: input columns and row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.session import pinned, ship  # noqa: F401  (pinned: for the operators)

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays (``lower`` would also change É or İ, so it only
    serves texts of ASCII alone, where it is much faster)."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names, so that extra columns of the caller
    can neither clash with working columns nor be carried through a shuffle. Every operator
    begins with it, so it also ships the package for the functions that run in tasks."""
    ship(df.sparkSession)
    return df.select(*[df[c].alias(name) for name, c in columns.items()])


def with_ref(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``ref`` (long, never null), ``doc_id``, ``text``. ``ref`` is the id where ids are unique
    integers (they pack well), else a hash of id and text: then rows that repeat an id stay
    apart, rows equal in both share a ``ref`` and all results."""
    d = pick(docs, doc_id=id_col, text=text_col)
    integral = dict(d.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    if integral:
        shared = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        shared = shared.filter((F.col("n") > 1) | F.col("doc_id").isNull())
        if shared.isEmpty():
            return d.select(F.col("doc_id").cast("long").alias("ref"), "doc_id", "text")
    return d.select(F.xxhash64("doc_id", "text").alias("ref"), "doc_id", "text")

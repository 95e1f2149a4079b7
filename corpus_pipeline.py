"""A corpus pipeline: toxicity, exact and near deduplication, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last returns the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provisio.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from provisio.llm.common import spool, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from docs and the labels outside fold 0.

    Null and empty texts stay, repeated rows are judged alike, and a null id has no label. No rows give none.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, by a new digest index: the longest, then that of the smallest id.

    Null texts are empty texts, a null id comes last, and of rows that agree in id and text one stays. No rows give none.
    """
    with exact_dedup.temporary_index(spark, docs) as index:
        return exact_dedup.keep_distinct(docs, index)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near SimHashes stays: that of the smallest id, a null id last.

    Null, empty and blank texts have one fingerprint, so one of them stays; of repeated rows one stays. No rows give none.
    """
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Texts without words stay, repeated rows go or stay together, null ids are told apart by text. No rows give none.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes.

    One row for each row of docs; texts without words give nothing, the null source is a source, and rows of one id
    and size are taken from alike. No rows give none.
    """
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]
#: SQL can't express the toxicity model or XXH64; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""Expressions and helpers that several training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(text, UPPER, LOWER)


def whole_text(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def space_words(text: Column) -> Column:
    """Words between ASCII white space, in order; an empty array for null or blank texts."""
    trimmed = F.btrim(whole_text(text), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def count_space_words(text: Column) -> Column:
    """How many words space_words() would return, as a long."""
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def in_fold(doc_id: Column, fold: int, folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls into the given fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df bears it, so that what an operator adds clashes with nothing."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with these columns alone; their names may hold dots."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir that driver and executors share.

    Only a local session may go without the setting; it then gets a folder of its own.
    """
    context = spark.sparkContext
    if not (folder := context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="provisio-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder


def shared_warehouse(spark: SparkSession) -> None:
    """Raise if tables would go to a folder that executors on other machines don't share: the default warehouse of a cluster session."""
    here = spark.conf.get("spark.sql.warehouse.dir")
    local = here.startswith("file:") or "://" not in here
    if local and os.path.realpath(here.removeprefix("file:")) == os.path.realpath("spark-warehouse") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.sql.warehouse.dir to a folder that driver and executors share")


def spool(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    It cuts the lineage, and what is read twice is computed once; lost executors cost only their running tasks.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

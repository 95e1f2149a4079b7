"""The store of runs: one Parquet folder a relation, partitioned by run, so a run is read by partition pruning."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(bundle: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Write all relations of a run; a run that is written again replaces its own partition alone."""
    for name, df in bundle.items():
        out = df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("run_id").parquet(f"{root}/{name}")


def read_relation(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{name}")
    return rows.filter(F.col("run_id") == run_id).drop("run_id") if run_id else rows


def list_runs(spark: SparkSession, root: str, relation: str = "sources") -> DataFrame:
    """Runs, the latest name first, with their number of rows."""
    return read_relation(spark, root, relation).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("run_id"))


def export_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV with a header, for spreadsheets."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the folder of spark.checkpoint.dir and read again: it cuts the lineage, survives lost executors.

    A local session without the setting gets a folder of its own; a cluster must name one that all share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not (folder := context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="provisio-"))
        folder = context.getCheckpointDir()
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Whole datasets of propositions: repair of the parts that failed, in the run store too; metadata; comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.runs import read_relation, written
from .diff import merge_runs
from .propositions import divergence, pair_by_index

#: Partitions of a run's relation, by a hash of the source; a repair rewrites those that hold a target.
BUCKETS = 64


def _key(rows: DataFrame) -> DataFrame:
    """rows with __source and __fragment, the job that a row comes from; blank fragments are none."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    return rows.withColumns({"__source": blank("source_record_id"), "__fragment": blank("source_fragment_id")})


def repair_targets(chunks: DataFrame) -> DataFrame:
    """The jobs (source_record_id, source_fragment_id; null for a whole source) of chunks that failed, each once; blank sources go."""
    rows = _key(chunks).filter("__source <> ''").select("__source", "__fragment").distinct()
    return rows.select(F.col("__source").alias("source_record_id"), F.when(F.col("__fragment") != "", F.col("__fragment")).alias("source_fragment_id"))


def repaired(props: DataFrame, targets: DataFrame, rerun: DataFrame) -> DataFrame:
    """props without those of the target jobs, and what the jobs have put out anew. A job without fragment is that of the rows without one."""
    kept = _key(props).join(_key(targets).select("__source", "__fragment"), ["__source", "__fragment"], "left_anti")
    return kept.select(props.columns).unionByName(rerun, allowMissingColumns=True)


def _bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.trim("source_record_id")), F.lit(BUCKETS)).cast("int"))


def write_bucketed(rows: DataFrame, root: str, name: str, run_id: str) -> None:
    """Write a run's relation into the store, partitioned by run and by source; partitions that rows has none for stay."""
    out = _bucket(rows).withColumn("run_id", F.lit(run_id)).repartition("run_id", "bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "bucket").parquet(f"{root}/{name}")


def repair_in_place(spark: SparkSession, root: str, name: str, run_id: str, targets: DataFrame, rerun: DataFrame) -> list[int]:
    """Repair a relation of the store: only partitions that hold a target's source are read and rewritten; returns them.

    The new rows are written aside first, as a partition can't be read and replaced at once.
    """
    touched = sorted(r.bucket for r in _bucket(targets.select("source_record_id").unionByName(rerun.select("source_record_id"))).select("bucket").distinct().collect())  # BUCKETS at most
    old = read_relation(spark, root, name, run_id).filter(F.col("bucket").isin(touched))
    new = written(_bucket(repaired(old.drop("bucket"), targets, rerun)).withColumn("run_id", F.lit(run_id)), "repaired")
    new.repartition("run_id", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "bucket").parquet(f"{root}/{name}")
    # A partition that has lost all its rows is in no output, so it is overwritten by itself, with none.
    left = {r.bucket for r in new.select("bucket").distinct().collect()}
    for bucket in set(touched) - left:
        new.limit(0).drop("run_id", "bucket").write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}/bucket={bucket}")
    return touched


def case_inputs(sources: DataFrame, traces: DataFrame) -> DataFrame:
    """One row of what a case would ask for: jurisdiction_a and _b (the first two, if there are two), focus_scopes.

    sources: jurisdiction; traces: ord, focus_scopes (array): the first that has any.
    """
    places = sources.filter("trim(jurisdiction) <> ''").select(F.trim("jurisdiction").alias("j")).distinct()
    two = places.orderBy("j").limit(2).agg(F.sort_array(F.collect_list("j")).alias("js"))
    clean = F.filter(F.transform(F.coalesce("focus_scopes", F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")
    focus = traces.select("ord", clean.alias("scopes")).filter(F.size("scopes") > 0).agg(F.min_by("scopes", "ord").alias("focus_scopes"))
    both = F.size("js") == 2
    return two.crossJoin(focus).select(F.when(both, F.col("js")[0]).alias("jurisdiction_a"), F.when(both, F.col("js")[1]).alias("jurisdiction_b"), "focus_scopes")  # one row each


def dataset_metadata(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """dataset_id, run_id, jurisdiction_scope (EU, UK, mixed, unknown), source_ids, quality_status for each run.

    runs: run_id, status; sources: run_id, id, jurisdiction. One other jurisdiction alone is unknown.
    """
    label = T.jurisdiction_label(F.coalesce("jurisdiction", F.lit("")))
    known = F.when(label != "unknown", label)
    held = sources.groupBy("run_id").agg(F.countDistinct(known).alias("n"), F.min(known).alias("only"), F.sort_array(F.collect_set(F.when(F.trim("id") != "", F.col("id")))).alias("source_ids"))
    rows = runs.join(held, "run_id", "left")
    scope = F.when(F.col("n") > 1, "mixed").when((F.col("n") == 1) & F.col("only").isin("EU", "UK"), F.col("only")).otherwise("unknown")
    return rows.select(F.concat(F.lit("pd:"), "run_id").alias("dataset_id"), "run_id", scope.alias("jurisdiction_scope"), F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"), F.coalesce(F.when(F.trim("status") != "", F.col("status")), F.lit("unknown")).alias("quality_status"))


def compare_datasets(left: DataFrame, right: DataFrame, jurisdiction_a: str, jurisdiction_b: str, key: list[str], order: list[str]) -> DataFrame:
    """Findings of two datasets laid together: the nth proposition of one jurisdiction against the nth of the other for each key.

    Both have the fields of propositions. An id in both is an error, as the union would not tell them apart.
    """
    merged, shared = merge_runs(left, right, "id")
    if clash := shared.take(1):
        raise ValueError(f"both datasets have the id {clash[0].id!r}")
    label = T.jurisdiction_label(F.coalesce("jurisdiction", F.lit("")))
    sides = (merged.filter(label == j) for j in (jurisdiction_a, jurisdiction_b))
    return divergence(pair_by_index(*sides, key, order))


def comparison_record(run_id: str, left: DataFrame, right: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: the run, the two datasets (of dataset_metadata(), one row each), how many findings of each type."""
    types = findings.groupBy("divergence_type").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.sort_array(F.collect_list(F.concat("divergence_type", F.lit("="), "n"))), "|").alias("findings_by_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))
    sides = left.select(F.col("dataset_id").alias("left_dataset_id"), F.col("run_id").alias("left_run_id")).crossJoin(right.select(F.col("dataset_id").alias("right_dataset_id"), F.col("run_id").alias("right_run_id")))
    return sides.crossJoin(types).select(F.lit(run_id).alias("comparison_run_id"), "*")  # one row each

"""Differences between runs, and unions of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_diff(baseline: DataFrame, candidate: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """key, change (added, removed, changed, unchanged) by a full join on the key and null-safe comparison."""
    b, c = baseline.select(key, F.struct(*compared).alias("__b")), candidate.select(key, F.struct(*compared).alias("__c"))
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__c").isNull(), "removed").when(F.col("__b").eqNullSafe(F.col("__c")), "unchanged").otherwise("changed")
    return b.join(c, key, "full").select(key, change.alias("change"))


def verdict(changes: DataFrame, unexplained: DataFrame, quality: tuple[int, int] = (0, 0)) -> DataFrame:
    """One row: counts by change and the verdict, a regression where rows went without reason or quality fell."""
    kinds = ("added", "removed", "changed")
    counts = changes.agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds)).crossJoin(unexplained.agg(F.count(F.lit(1)).alias("unexplained")))
    said = F.when((F.col("unexplained") > 0) | F.lit(quality[1] > quality[0]), "regression").when(F.col("added") + F.col("removed") + F.col("changed") > 0, "changed").otherwise("unchanged")
    return counts.withColumn("verdict", said)


def unexplained_removals(baseline: DataFrame, candidate: DataFrame, key: str, parents: list[str]) -> DataFrame:
    """Rows of baseline whose key is gone from candidate though all their (non-null) parents are still there."""
    gone = baseline.join(candidate.select(key), key, "left_anti")
    for p in parents:
        there = candidate.select(F.col(p).alias("__p")).distinct().withColumn("__there", F.lit(True))
        gone = gone.join(there, F.col(p) == F.col("__p"), "left").filter(F.col(p).isNull() | F.col("__there").isNotNull()).drop("__p", "__there")
    return gone


def merge_runs(left: DataFrame, right: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Union of two runs, and the ids that both hold; a caller refuses the union when there are any."""
    return left.unionByName(right, allowMissingColumns=True), left.select(id_col).intersect(right.select(id_col))

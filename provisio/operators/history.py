"""Ordered comparisons: version history, snapshot timelines, quotas by turns, first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_changes(rows: DataFrame, key: list[str], order: list[str], text: str, metadata: list[str]) -> DataFrame:
    """Add position (from 0), change and changed_fields against the row before: initial, no_change, text_only,
    metadata_only or text_and_metadata."""
    over = W.partitionBy(*key).orderBy(*order)
    before = rows.withColumns({"position": F.row_number().over(over) - 1, "__text": F.lag(F.struct(text)).over(over), **{f"__{m}": F.lag(F.struct(m)).over(over) for m in metadata}})
    first = F.col("__text").isNull()
    differs = lambda c: ~F.struct(c).eqNullSafe(F.col(f"__{c}" if c != text else "__text"))
    fields = F.array_compact(F.array(*(F.when(~first & differs(m), F.lit(m)) for m in metadata)))
    before = before.withColumns({"changed_fields": fields, "__new": ~first & differs(text)})
    change = F.when(first, "initial").when(F.col("__new") & (F.size("changed_fields") > 0), "text_and_metadata").when(F.col("__new"), "text_only").when(F.size("changed_fields") > 0, "metadata_only").otherwise("no_change")
    return before.withColumn("change", change).select(*rows.columns, "position", "change", "changed_fields")


def round_robin(rows: DataFrame, key: list[str], bucket: str, order: list[str], quota: int) -> DataFrame:
    """quota rows a key by turns over its buckets, the buckets in the order of their first rows."""
    in_bucket = W.partitionBy(*key, bucket).orderBy(*order)
    dealt = rows.withColumns({"__turn": F.row_number().over(in_bucket), "__first": F.first(F.struct(*order)).over(in_bucket)})
    place = F.row_number().over(W.partitionBy(*key).orderBy("__turn", "__first"))
    return dealt.withColumn("place", place).filter(F.col("place") <= quota).drop("__turn", "__first")


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; pre-aggregated, so a very common key costs one row a task."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(*key, "r.*")

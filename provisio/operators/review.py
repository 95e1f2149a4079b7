"""Append-only review: current decisions, effective views, allowed transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The edges of the review state machine.
TRANSITIONS = {
    "proposed": ["accepted", "accepted_with_edits", "rejected", "needs_more_sources", "superseded"],
    "needs_more_sources": ["proposed", "accepted", "accepted_with_edits", "rejected", "superseded"],
    "accepted": ["superseded"],
    "accepted_with_edits": ["superseded"],
    "rejected": ["proposed", "superseded"],
    "superseded": [],
    "draft": ["proposed", "in_review", "accepted", "accepted_with_edits", "rejected", "needs_more_sources", "superseded"],
    "in_review": ["proposed", "accepted", "accepted_with_edits", "rejected", "needs_more_sources"],
}


def current_decisions(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """The latest decision of each artefact, by time as text, then id, among those that no decision supersedes."""
    gone = decisions.filter("trim(supersedes) <> ''").select(F.trim("supersedes").alias("id")).distinct()
    left = decisions.join(gone, "id", "left_anti")
    others = [c for c in decisions.columns if c not in keys]
    latest = left.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.coalesce("reviewed_at", F.lit("")), F.col("id"))).alias("d"))
    return latest.select(*keys, "d.*")


def effective(artefacts: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Artefacts under their current decision: status `generated` without one, replaced fields where it overrides.

    current: key, decision, replacement (map of field to value), reason.
    """
    joined = artefacts.join(current.select(key, F.lower(F.trim("decision")).alias("effective_status"), "replacement", "reason"), key, "left")
    over = F.col("effective_status") == "overridden"
    shown = {f: F.when(over, F.coalesce(F.try_element_at("replacement", F.lit(f)), F.col(f))).otherwise(F.col(f)) for f in fields}
    return joined.withColumns({**shown, "effective_status": F.coalesce("effective_status", F.lit("generated")), "review_reason": F.coalesce("reason", F.lit(""))}).drop("replacement", "reason")


def transitions(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Each status with the one before it and whether that step is allowed."""
    edges = F.create_map(*(x for a, bs in TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, bs)).cast("array<string>"))))
    before = F.lag(status).over(W.partitionBy(key).orderBy(*order))
    rows = events.withColumn("previous_status", before)
    allowed = F.col("previous_status").isNull() | (F.col("previous_status") == F.col(status)) | F.coalesce(F.array_contains(edges[F.col("previous_status")], F.col(status)), F.lit(False))
    return rows.withColumn("allowed", allowed)

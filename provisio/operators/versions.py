"""History over runs and registry: snapshots seen in several places as one event, versions nested by snapshot and by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import with_changes

#: Fields of a snapshot besides its source.
FIELDS = ["id", "version_id", "content_hash", "retrieved_at", "as_of_date", "authoritative_text", "authoritative_locator", "provenance"]
METADATA = ["version_id", "content_hash", "as_of_date", "provenance", "authoritative_locator"]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def safe_time(value: Column) -> Column:
    """The ISO time, or the least one where there is none that can be read."""
    return F.coalesce(F.try_to_timestamp(value), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def event_id() -> Column:
    """Snapshots of one source, version, content and time are one event."""
    return F.concat_ws("::", F.lit("snapshot-event"), *map(_text, ("source_record_id", "version_id", "content_hash", "retrieved_at")))


def refresh_snapshots(refreshes: DataFrame, known: DataFrame) -> DataFrame:
    """A snapshot for each refresh that a registry has recorded, filled up from the snapshot it names by id, else by content.

    refreshes: registry_id, source_record_id, source_snapshot_id, content_hash, version_id, refreshed_at, position;
    known: source_record_id, FIELDS and seq, of which the last counts. Keys are pre-aggregated, so a snapshot that every
    run holds costs one row.
    """
    held = F.struct(*FIELDS)
    last = lambda key, name: known.filter(_text(key) != "").groupBy("source_record_id", F.col(key).alias(f"__{name}")).agg(F.max(F.struct(F.col("seq"), held.alias("held")))["held"].alias(name))
    rows = refreshes.withColumns({"__by_id": _text("source_snapshot_id"), "__by_hash": _text("content_hash")})
    rows = rows.join(last("id", "by_id"), ["source_record_id", "__by_id"], "left").join(last("content_hash", "by_hash"), ["source_record_id", "__by_hash"], "left")
    rows = rows.withColumn("ref", F.coalesce("by_id", "by_hash"))
    filled = lambda own, other, default="": F.coalesce(F.when(own != "", own), F.when(other.isNotNull() & (other != ""), other), F.lit(default))
    return rows.select(
        "registry_id", "source_record_id", "refreshed_at", "position", filled(_text("source_snapshot_id"), F.col("ref.id")).alias("id"), filled(_text("version_id"), F.col("ref.version_id"), "unknown").alias("version_id"),
        filled(_text("content_hash"), F.col("ref.content_hash")).alias("content_hash"), filled(F.coalesce(F.col("ref.retrieved_at"), F.lit("")), _text("refreshed_at")).alias("retrieved_at"), F.col("ref.as_of_date").alias("as_of_date"),
        F.coalesce("ref.authoritative_text", F.lit("")).alias("authoritative_text"), F.coalesce("ref.authoritative_locator", F.lit("document:full")).alias("authoritative_locator"),
        filled(F.coalesce(F.col("ref.provenance"), F.lit("")), F.lit(""), "registry.refresh_history").alias("provenance"),
    )


def snapshot_history(runs: DataFrame, current: DataFrame, refreshes: DataFrame) -> DataFrame:
    """All snapshots of each source, one row for each event, in the order of time.

    runs: run_id and a snapshot's columns; current: registry_id and a snapshot's columns; refreshes: see
    refresh_snapshots(). Returns source_record_id, event_id, FIELDS, origins (array of kind, name, at; each once, runs
    first), position, change, changed_fields. An event shows the first snapshot that has a text, else the first. The
    result does not depend on the order of the rows.
    """
    snapshot = ["source_record_id", *FIELDS]
    none = F.lit("")
    from_runs = runs.select(*snapshot, F.struct(F.lit(0).alias("rank"), F.col("run_id").alias("name"), F.lit(0).alias("position")).alias("seq"), F.struct(F.lit("run_snapshot").alias("kind"), F.col("run_id").alias("name"), none.alias("at")).alias("origin"))
    from_state = current.select(*snapshot, F.struct(F.lit(1).alias("rank"), F.col("registry_id").alias("name"), F.lit(0).alias("position")).alias("seq"), F.struct(F.lit("registry_current_state").alias("kind"), F.col("registry_id").alias("name"), none.alias("at")).alias("origin"))
    known = from_runs.unionByName(from_state)
    past = refresh_snapshots(refreshes, known)
    from_past = past.select(*snapshot, F.struct(F.lit(1).alias("rank"), F.col("registry_id").alias("name"), (F.col("position") + 1).alias("position")).alias("seq"), F.struct(F.lit("registry_refresh").alias("kind"), F.col("registry_id").alias("name"), _text("refreshed_at").alias("at")).alias("origin"))
    every = known.unionByName(from_past).withColumn("event_id", event_id())
    held = F.struct((_text("authoritative_text") == "").alias("bare"), F.col("seq"), *FIELDS)
    once = every.groupBy("source_record_id", "event_id", "origin").agg(F.min("seq").alias("seq"), F.min(held).alias("held"))
    events = once.groupBy("source_record_id", "event_id").agg(F.min("held").alias("held"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "origin"))), lambda s: s["origin"]).alias("origins"))
    flat = events.select("source_record_id", "event_id", *(F.col(f"held.{f}").alias(f) for f in FIELDS), "origins")
    flat = flat.withColumns({"__at": safe_time(F.col("retrieved_at")), "__as_of": _text("as_of_date"), "__id": _text("id")})
    return with_changes(flat, ["source_record_id"], ["__at", "__as_of", "__id", "event_id"], "authoritative_text", METADATA).drop("__at", "__as_of", "__id")


def nested(versions: DataFrame, key: list[str], by: str, name: str, unknown: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row for each key: `groups`, an array of (name, observed_version_count, observed_versions) sorted by name.

    by is a text, or an array of texts of which each gets the version; null, empty and missing ones count as
    `unknown`. Versions stand in the order given and have `fields`.
    """
    many = versions.schema[by].dataType.typeName() == "array"
    given = F.explode_outer(F.when(F.size(by) > 0, F.col(by))) if many else F.col(by)
    rows = versions.withColumn("__by", given).withColumn("__by", F.when(F.coalesce("__by", F.lit("")) == "", unknown).otherwise(F.col("__by")))
    version = F.struct(F.struct(*order).alias("__order"), F.struct(*fields).alias("version"))
    inner = rows.groupBy(*key, "__by").agg(F.transform(F.sort_array(F.collect_list(version)), lambda v: v["version"]).alias("observed_versions"))
    group = F.struct(F.col("__by").alias(name), F.size("observed_versions").alias("observed_version_count"), "observed_versions")
    return inner.groupBy(*key).agg(F.sort_array(F.collect_list(group)).alias("groups"))


def by_snapshot(versions: DataFrame, key: list[str], order: list[str], fields: list[str], snapshots: str = "source_snapshot_id") -> DataFrame:
    """Versions nested by the snapshots they come from; snapshots may be an array."""
    return nested(versions, key, snapshots, "source_snapshot_id", "snapshot-unknown", order, fields)


def by_run(versions: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Versions nested by the run that has observed them."""
    return nested(versions, key, "observed_in_run_id", "observed_in_run_id", "run-unknown", order, fields)

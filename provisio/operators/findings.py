"""Joins that build a run's records: findings with their observations, fetch metadata, merged sources, source inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# What an observation says about missing evidence, in this order.
LIMITS = ["primary fragment inferred from source record fallback or unavailable", "comparator fragment inferred from source record fallback or unavailable", "no additional supporting fragments inferred"]


def _filled(column: Column) -> Column:
    return F.when(F.coalesce(F.trim(column), F.lit("")) != "", column)


def last_fragments(fragments: DataFrame) -> DataFrame:
    """source_record_id, fragment: the last fragment of each source by ord; one row a task for a source of any size."""
    return fragments.groupBy("source_record_id").agg(F.max_by(F.col("id"), F.struct("ord", "id")).alias("fragment"))


def findings_and_observations(assessments: DataFrame, sources: DataFrame, fragments: DataFrame, props: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, observations) of divergence assessments.

    assessments: ord, id, finding_id, proposition_id, comparator_proposition_id, jurisdiction_a, jurisdiction_b,
    sources_checked (array); sources: id, current_snapshot_id, as_of_date; fragments: id, source_record_id, ord; props: id,
    source_record_id, source_fragment_id. An observation has the snapshots and the latest date of the sources
    checked, the fragment of either proposition (its own, else the last of its source), the last fragments of the sources
    checked besides these two, and what is missing. A finding is the first of its assessments; without an id it is named by
    its two propositions. Unknown sources and propositions give nulls and limits.
    """
    last = last_fragments(fragments)
    own = props.join(last, "source_record_id", "left").select("id", F.coalesce(_filled(F.col("source_fragment_id")), "fragment").alias("fragment"))
    first, second = (own.select(F.col("id").alias(c), F.col("fragment").alias(f)) for c, f in (("proposition_id", "primary_fragment"), ("comparator_proposition_id", "comparator_fragment")))
    base = assessments.join(first, "proposition_id", "left").join(second, "comparator_proposition_id", "left")
    checked = assessments.select("ord", "id", F.posexplode("sources_checked").alias("place", "source"))
    known = checked.join(sources.select(F.col("id").alias("source"), "current_snapshot_id", "as_of_date"), "source", "left").join(last.withColumnRenamed("source_record_id", "source"), "source", "left")
    # An assessment lists the few sources it has checked.
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(_filled(F.col(c)).isNotNull(), F.struct("place", c)))), lambda s: s[c])
    gathered = known.groupBy("ord", "id").agg(listed("current_snapshot_id").alias("source_snapshot_ids"), F.max(_filled(F.col("as_of_date"))).alias("as_of_date"), listed("fragment").alias("__fragments"))
    none = F.array().cast("array<string>")
    rows = base.join(gathered, ["ord", "id"], "left")
    others = F.filter(F.coalesce("__fragments", none), lambda f: ~f.eqNullSafe(F.col("primary_fragment")) & ~f.eqNullSafe(F.col("comparator_fragment")))
    rows = rows.withColumns({"source_snapshot_ids": F.coalesce("source_snapshot_ids", none), "supporting_fragments": others})
    missing = [F.col("primary_fragment").isNull(), F.col("comparator_fragment").isNull(), F.size("supporting_fragments") == 0]
    limits = F.array_compact(F.array(*(F.when(m, F.lit(t)) for m, t in zip(missing, LIMITS, strict=True))))
    named = F.coalesce(_filled(F.col("finding_id")), F.concat(F.lit("finding-"), "proposition_id", F.lit("-"), "comparator_proposition_id"))
    observations = rows.select("ord", "id", named.alias("finding_id"), "proposition_id", "comparator_proposition_id", "jurisdiction_a", "jurisdiction_b", "source_snapshot_ids", "as_of_date", "primary_fragment", "comparator_fragment", "supporting_fragments", limits.alias("limitations"))
    fields = ["proposition_id", "comparator_proposition_id", "jurisdiction_a", "jurisdiction_b"]
    findings = observations.groupBy("finding_id").agg(F.min_by(F.struct(*fields), F.struct("ord", "id")).alias("f"), F.count(F.lit(1)).alias("observations")).select("finding_id", "f.*", "observations")
    return findings, observations


def fetch_metadata(sources: DataFrame, traces: DataFrame) -> DataFrame:
    """Fetch metadata of each source that has a trace.

    sources: id, citation, source_url, retrieved_at, content_hash; traces: source_record_id, authority,
    authority_source_id, fetch_status, decision, content_hash, cache_key, version_id. A blank status falls back to the decision, then "unknown".
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    t = traces.select(F.col("source_record_id").alias("id"), *(F.col(c).alias(f"t_{c}") for c in ("authority", "authority_source_id", "fetch_status", "decision", "content_hash", "cache_key", "version_id")))
    rows = sources.join(t, "id")
    return rows.select(
        F.concat(F.lit("fetch-"), T.slug(F.col("id"))).alias("fetch_id"), F.col("id").alias("source_record_id"), blank("t_authority").alias("authority"), _filled(F.col("t_authority_source_id")).alias("source_identifier"), _filled(F.col("citation")).alias("citation"), _filled(F.col("source_url")).alias("source_url"),
        "retrieved_at", F.coalesce(_filled(F.col("content_hash")), blank("t_content_hash")).alias("content_hash"), F.coalesce(_filled(F.col("t_fetch_status")), _filled(F.col("t_decision")), F.lit("unknown")).alias("fetch_status"), F.concat(F.lit("bundle://source_records/"), "id").alias("parsed_artifact_uri"), _filled(F.col("t_cache_key")).alias("cache_key"), _filled(F.col("t_version_id")).alias("version_id"),
    )


def merged_sources(mirror: DataFrame, primary: DataFrame, inventory: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each source: of the mirror, with the fields that primary has laid over it, else of the inventory.

    Each relation has id and `fields`; a field that a relation lacks as a column lays nothing over, a null one does
    so only if the relation has set it (column `set`, an array of field names; all if there is no such column). Blank
    ids go. `summary_only` tells rows of the inventory.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.filter(F.trim("id") != "").withColumn("id", F.trim("id"))
        given = F.col("set") if "set" in df.columns else F.array(*(F.lit(f) for f in fields if f in df.columns)).cast("array<string>")
        held = F.struct(*(F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields), given.alias("set"))
        keep = F.max_by if name == "primary" else F.min_by
        return rows.groupBy("id").agg(keep(held, "ord").alias(name))

    met = side(mirror, "mirror").join(side(primary, "primary"), "id", "full").join(side(inventory, "inventory"), "id", "full")
    real = F.col("mirror").isNotNull() | F.col("primary").isNotNull()
    laid = lambda f: F.when(F.col("primary").isNotNull() & F.array_contains("primary.set", f), F.col(f"primary.{f}")).otherwise(F.coalesce(F.col(f"mirror.{f}"), F.col(f"primary.{f}")))
    return met.select("id", *(F.when(real, laid(f)).otherwise(F.col(f"inventory.{f}")).alias(f) for f in fields), (~real).alias("summary_only"))


def family_keys(sources: DataFrame) -> DataFrame:
    """source_record_id, family, jurisdiction of each source: its instrument id, else the family token, else the source itself."""
    family = F.coalesce(_filled(F.col("instrument_id")), _filled(F.col("family_token")), F.concat(F.lit("__source:"), "id"))
    return sources.groupBy("id").agg(F.first(F.struct(family.alias("family"), F.coalesce(_filled(F.col("jurisdiction")), F.lit("—")).alias("jurisdiction"))).alias("s")).select(F.col("id").alias("source_record_id"), "s.*")


def with_family(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with family and source_jurisdiction: "__no_source__" without a source, "__orphan__:id" where it is unknown."""
    keys = family_keys(sources).withColumnRenamed("jurisdiction", "source_jurisdiction")
    named = rows.withColumn("source_record_id", F.coalesce(F.trim("source_record_id"), F.lit(""))).join(keys, "source_record_id", "left")
    lost = F.when(F.col("source_record_id") == "", "__no_source__").otherwise(F.concat(F.lit("__orphan__:"), "source_record_id"))
    return named.withColumns({"family": F.coalesce("family", lost), "source_jurisdiction": F.coalesce("source_jurisdiction", F.lit("—"))})


def source_inventory(sources: DataFrame, fetches: DataFrame) -> DataFrame:
    """One row for each source: its fetch metadata and the run's primary target.

    sources: ord, id, jurisdiction, title, kind, status, citation, instrument_id, is_target_source; fetches: of
    fetch_metadata(). The primary target is the first source that is flagged as such, else the first source: one row, so it
    is joined to all.
    """
    flag = F.coalesce(F.col("is_target_source"), F.lit(False))
    lead = F.min(F.struct((~flag).alias("later"), "ord", "id", "citation", "title", "instrument_id"))
    instrument = F.coalesce(_filled(F.col("t.instrument_id")), _filled(F.col("t.citation")), F.col("t.id"))
    target = sources.agg(lead.alias("t")).select(F.col("t.id").alias("primary_target_id"), _filled(F.col("t.citation")).alias("primary_target_citation"), instrument.alias("primary_target_instrument"))
    rows = sources.join(fetches.select(F.col("source_record_id").alias("id"), "fetch_id", "fetch_status"), "id", "left").crossJoin(F.broadcast(target))  # a single row
    return rows.select(
        F.concat(F.lit("source-inventory-"), T.slug(F.col("id"))).alias("row_id"), F.col("id").alias("source_record_id"), "jurisdiction", F.coalesce(_filled(F.col("instrument_id")), _filled(F.col("citation")), F.col("id")).alias("instrument_id"), "title", F.col("kind").alias("instrument_type"), "status", _filled(F.col("citation")).alias("citation"),
        "fetch_id", "fetch_status", "primary_target_id", "primary_target_citation", "primary_target_instrument", (F.col("id") == F.col("primary_target_id")).alias("is_primary_target"),
    )

"""Overrides of review decisions: laid over their artefact, and checked against the artefact's fields.

A replacement is JSON; its fields are read as variants, so a number where a text belongs is seen as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the artefacts that an override may touch, by kind: text, text or null, texts, flag or null, object, or one of a list.
STATUSES = ["proposed", "accepted", "accepted_with_edits", "rejected", "needs_more_sources", "needs_review", "superseded", "draft", "in_review"]
SCHEMAS: dict[str, dict[str, str | list[str]]] = {
    "proposition": {
        "id": "text", "topic_id": "text", "source_record_id": "text", "jurisdiction": "text", "proposition_text": "text", "legal_subject": "text", "action": "text", "label": "text", "short_name": "text", "slug": "text", "notes": "text",
        "source_snapshot_id": "text?", "source_fragment_id": "text?", "fragment_locator": "text?", "article_reference": "text?", "authority": "text?", "conditions": "texts", "required_documents": "texts", "affected_subjects": "texts", "categories": "texts", "tags": "texts", "review_status": STATUSES,
    },
    "source_target_link": {"id": "text", "source_record_id": "text", "target_source_record_id": "text?", "target_citation": "text?", "target_instrument_id": "text?", "link_type": "text", "confidence": "text", "method": "text", "reason": "text", "evidence": "texts", "signals": "object"},
    "proposition_extraction_trace": {"id": "text", "proposition_id": "text", "extraction_method": ["heuristic", "llm", "manual", "imported", "fallback"], "confidence": ["high", "medium", "low"], "reason": "text", "evidence_text": "text?", "evidence_locator": "text?", "warnings": "texts", "errors": "texts", "fallback_used": "flag?", "signals": "object"},
    "source_categorisation_rationale": {"source_record_id": "text", "source_role": "text", "relationship_to_analysis": "text", "method": "text", "confidence": "text", "reason": "text", "evidence": "texts", "signals": "object"},
    "source_inventory_row": {"id": "text", "source_record_id": "text", "title": "text", "source_role": "text", "relationship_to_analysis": "text", "content_hash": "text", "source_url": "text?", "citation": "text?", "version_id": "text?", "metadata": "object"},
}


def _fields(spark: SparkSession) -> DataFrame:
    """The schemas as a relation: artifact_type, field, place, kind, allowed."""
    rows = [(t, f, place, "one of" if isinstance(k, list) else k, k if isinstance(k, list) else []) for t, fields in SCHEMAS.items() for place, (f, k) in enumerate(fields.items())]
    return spark.createDataFrame(rows, "artifact_type string, field string, place int, kind string, allowed array<string>")


def _breaks(shape: Column, said: Column) -> Column:
    """Whether a value of this shape breaks the kind of its field."""
    fits = {"text": shape == "STRING", "text?": shape.isin("STRING", "VOID"), "texts": shape.isin("ARRAY<STRING>", "ARRAY<VOID>"), "flag?": shape.isin("BOOLEAN", "VOID"), "object": F.startswith(shape, F.lit("OBJECT")), "one of": (shape == "STRING") & F.array_contains("allowed", said)}
    return ~F.coalesce(*(F.when(F.col("kind") == k, fit) for k, fit in fits.items()))


def override_faults(decisions: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Overrides that can't be laid over their artefact: id, rule, artifact_type, artifact_id, fault.

    decisions: id, artifact_type, artifact_id, decision, replacement (JSON text or null); artefacts: artifact_type,
    artifact_id of all artefacts. L1: a type without fields of its own; L2: no such artefact; L3: the replacement is no
    object, or one of its fields breaks the artefact's (the first by the order of the fields). Fields that the artefact does not know are let through.
    """
    over = decisions.filter("lower(trim(decision)) = 'overridden' AND replacement IS NOT NULL").withColumns({"artifact_type": F.trim("artifact_type"), "artifact_id": F.trim("artifact_id"), "value": F.try_parse_json("replacement")})
    there = artefacts.select("artifact_type", "artifact_id").distinct().withColumn("there", F.lit(True))
    rows = over.join(there, ["artifact_type", "artifact_id"], "left")
    is_object = F.coalesce(F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")), F.lit(False))
    # The replaced fields, a row each, meet the schema's in a hash join.
    given = decisions.sparkSession.sql("SELECT id, artifact_type, key AS field, schema_of_variant(v.value) AS shape, try_variant_get(v.value, '$', 'string') AS said FROM {rows} r, LATERAL variant_explode(r.value) v", rows=rows.filter(is_object).select("id", "artifact_type", "value"))
    broken = given.join(F.broadcast(_fields(decisions.sparkSession)), ["artifact_type", "field"]).filter(_breaks(F.col("shape"), F.col("said")))  # as many rows as the schemas have fields
    first = broken.groupBy("id", "artifact_type").agg(F.min_by(F.concat("field", F.lit(": found "), "shape"), "place").alias("broken"))
    rows = rows.join(first, ["id", "artifact_type"], "left")
    faults = F.col("broken")
    unsupported = ~F.coalesce(F.col("artifact_type").isin(list(SCHEMAS)), F.lit(False))
    fault = F.when(unsupported, "unsupported artifact_type").when(F.col("there").isNull(), "missing artifact").when(~is_object, "replacement is no object").otherwise(faults)
    rule = F.when(unsupported, "L1").when(F.col("there").isNull(), "L2").otherwise("L3")
    return rows.select("id", rule.alias("rule"), "artifact_type", "artifact_id", fault.alias("fault")).filter("fault IS NOT NULL")


def overridden(artefacts: DataFrame, decisions: DataFrame, artifact_type: str) -> DataFrame:
    """Artefacts (with `id` and fields of the type's schema) under their overrides, and `overridden`.

    decisions: one for each artefact, the one in force. A replaced field takes the replacement's value, null too; others
    stay. Decisions of other types, other kinds, or with a faulty replacement change nothing.
    """
    fields = SCHEMAS[artifact_type]
    faulty = override_faults(decisions, artefacts.select(F.lit(artifact_type).alias("artifact_type"), F.col("id").alias("artifact_id")))
    valid = decisions.filter((F.trim("artifact_type") == artifact_type) & (F.lower(F.trim("decision")) == "overridden")).join(faulty.select("id"), "id", "left_anti")
    laid = valid.select(F.trim("artifact_id").alias("id"), F.try_parse_json("replacement").alias("__new")).filter("__new IS NOT NULL")
    rows = artefacts.join(laid, "id", "left")

    def shown(f: str) -> Column:
        given = F.variant_get("__new", f"$.{f}", "variant")
        return F.when(given.isNotNull(), F.try_variant_get("__new", f"$.{f}", artefacts.schema[f].dataType.simpleString())).otherwise(F.col(f))

    touched = [f for f in artefacts.columns if f in fields and f != "id"]
    return rows.withColumns({f: shown(f) for f in touched} | {"overridden": F.col("__new").isNotNull()}).drop("__new")

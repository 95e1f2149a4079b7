"""Rows that a model has put out: read from its JSON, checked against the source, made into propositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# What enumerated fields may hold.
PROVISION_TYPES = ["core", "definition", "exception", "transitional", "cross_reference"]
COMPLETENESS = ["complete", "context_dependent", "fragmentary"]
ITEM = "proposition_text string, evidence_text string, reason string, source_locator string, display_label string, subject string, rule string, object string, conditions array<string>, exceptions array<string>, temporal_condition string, provision_type string, completeness_status string"


def _t(column: str) -> Column:
    return F.coalesce(F.trim(column), F.lit(""))


def items(outputs: DataFrame, objects_only: bool = True) -> DataFrame:
    """The items of each output, in order: source_id, row_index, item (JSON text), is_object.

    outputs: source_id, output: a JSON array, or an object with the array `propositions`; anything else has no items.
    Items that are no objects are left out before numbering, unless objects_only is off.
    """
    inner = F.from_json("output", "propositions array<string>")["propositions"]
    whole = F.from_json("output", "array<string>")
    found = F.when(F.startswith(F.ltrim("output"), F.lit("[")), whole).when(F.startswith(F.ltrim("output"), F.lit("{")), inner)
    is_object = lambda i: F.coalesce(F.startswith(F.ltrim(i), F.lit("{")), F.lit(False))
    rows = outputs.select("source_id", F.posexplode(F.filter(found, is_object) if objects_only else found).alias("row_index", "item"))
    return rows.withColumn("is_object", is_object(F.col("item")))


def checked(rows: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """Each item that is looked at, with why it is refused: source_id, row_index, reason_code (null: accepted), failure_reason,
    strategy, accepted_index, and the item's fields.

    rows: of items(); sources: source_id, source_text. Reasons in this order: invalid_row_type, empty_proposition,
    empty_evidence_no_reason, no_verbatim_normalized_span, duplicate_proposition_same_locator (of wordings alike but for
    case and space), invalid_provision_type, invalid_completeness. Items behind the `limit`-th accepted one of a
    source are not looked at. A window takes the items of one source's output, which a model's answer bounds.
    """
    parsed = rows.withColumn("i", F.when(F.col("is_object"), F.from_json("item", ITEM))).select("source_id", "row_index", "is_object", "i.*")
    met = parsed.join(sources, "source_id", "left")
    evidence = _t("evidence_text")
    match = F.when(evidence != "", T.evidence_match(evidence, F.coalesce("source_text", F.lit(""))))
    met = met.withColumn("strategy", F.coalesce(match, F.lit(""))).drop("source_text")
    early = (
        F.when(~F.col("is_object"), "invalid_row_type").when(_t("proposition_text") == "", "empty_proposition").when((evidence == "") & (_t("reason") == ""), "empty_evidence_no_reason")
        .when((evidence != "") & (F.col("strategy") == ""), "no_verbatim_normalized_span")
    )
    met = met.withColumns({"__early": early, "__said": F.lower(T.squash(_t("proposition_text"))), "__place": F.lower(_t("source_locator"))})
    nth = F.row_number().over(W.partitionBy("source_id", F.col("__early").isNull(), "__said", "__place").orderBy("row_index"))
    wrong = lambda c, allowed: F.col(c).isNotNull() & ~F.col(c).isin(allowed)
    met = met.withColumn("__nth", nth)
    met = met.withColumn("reason_code", F.coalesce("__early", F.when(F.col("__nth") > 1, "duplicate_proposition_same_locator").when(wrong("provision_type", PROVISION_TYPES), "invalid_provision_type").when(wrong("completeness_status", COMPLETENESS), "invalid_completeness")))
    before = F.coalesce(F.sum(F.when(F.col("reason_code").isNull(), 1).otherwise(0)).over(W.partitionBy("source_id").orderBy("row_index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    said = {
        "invalid_row_type": "expected object", "empty_proposition": "proposition_text empty", "empty_evidence_no_reason": "evidence_text empty but reason does not explain why (copy verbatim or leave empty only with justification)", "no_verbatim_normalized_span": "evidence_text not traceable to source",
        "duplicate_proposition_same_locator": "duplicate proposition_text for same locator", "invalid_provision_type": "invalid provision_type", "invalid_completeness": "invalid completeness_status",
    }
    message = F.concat(F.lit("row "), "row_index", F.lit(": "), F.coalesce(*(F.when(F.col("reason_code") == k, v) for k, v in said.items())))
    looked_at = met.withColumn("accepted_index", before).filter(F.col("accepted_index") < limit)
    return looked_at.withColumns({"failure_reason": F.when(F.col("reason_code").isNotNull(), message), "accepted_index": F.when(F.col("reason_code").isNull(), F.col("accepted_index"))}).drop("__early", "__said", "__place", "__nth", "is_object")


def propositions(accepted: DataFrame, sources: DataFrame, first: int = 1) -> DataFrame:
    """Propositions of accepted items, as checked() numbers them.

    sources: source_id, jurisdiction, authoritative_locator, current_snapshot_id. Blank subjects and rules are guessed from the wording;
    exceptions and a temporal condition become conditions. Ids number the accepted items of a source from `first`.
    """
    rows = accepted.filter("reason_code IS NULL").join(sources, "source_id")
    text = _t("proposition_text")
    or_guess = lambda c, guess: F.when(_t(c) != "", _t(c)).otherwise(guess)
    none = F.array().cast("array<string>")
    kept = lambda c, mark: F.transform(F.filter(F.coalesce(c, none), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), lambda x: F.concat(F.lit(mark), F.trim(x) if mark else x))
    when = F.when(_t("temporal_condition") != "", F.array(F.concat(F.lit("temporal: "), _t("temporal_condition")))).otherwise(none)
    place = F.coalesce(F.when(_t("source_locator") != "", _t("source_locator")), F.col("authoritative_locator"))
    rows = rows.withColumns({"__subject": or_guess("subject", T.subject(text)), "__place": place})
    return rows.select(
        F.concat(F.lit("prop-"), T.slug(F.col("source_id")), F.lit("-"), F.lpad((F.col("accepted_index") + first).cast("string"), F.greatest(F.lit(3), F.length((F.col("accepted_index") + first).cast("string"))), F.lit("0"))).alias("id"), F.col("source_id").alias("source_record_id"), F.col("current_snapshot_id").alias("source_snapshot_id"), "jurisdiction",
        F.col("__place").alias("fragment_locator"), F.when(T.is_placeholder(F.col("__place")), T.article_reference(text)).otherwise(T.locator_reference(F.col("__place"))).alias("article_reference"), text.alias("proposition_text"), _t("display_label").alias("label"), F.left(_t("display_label"), F.lit(200)).alias("short_name"), F.col("__subject").alias("legal_subject"), or_guess("rule", T.action(text)).alias("action"),
        F.concat(kept("conditions", ""), kept("exceptions", "exception: "), when).alias("conditions"), F.array(or_guess("object", F.col("__subject"))).alias("affected_subjects"), _t("reason").alias("notes"), "strategy", "accepted_index",
    )


def stamped(props: DataFrame, mode: str, model: str | None, policy: str, fell_back: bool, versions: tuple[str, str]) -> DataFrame:
    """props with `meta`: JSON of how they were extracted; columns validation_errors (array) and strategy go into it."""
    fields = {"extraction_mode": F.lit(mode), "model_alias": F.lit(model), "fallback_policy": F.lit(policy), "fallback_used": F.lit(fell_back), "validation_errors": F.col("validation_errors"), "prompt_version": F.lit(versions[0]), "schema_version": F.lit(versions[1]), "evidence_match_strategy": F.col("strategy")}
    return props.withColumn("meta", F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))))

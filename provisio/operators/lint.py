"""Integrity rules as a registry of filters and anti-joins, and the quality gates they feed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .overrides import override_faults

Tables = dict[str, DataFrame]
Rule = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Check:
    """A rule: its code, severity, gate, message before the id, and the rows (column id) that break it."""

    code: str
    severity: str
    gate: str
    message: str
    broken: Rule


class Absent(LookupError):
    """A rule has asked for a table that the run lacks."""


class Given(dict):
    """A run's tables, which tells a table that is not there from any other error."""

    def __missing__(self, name: str) -> DataFrame:
        raise Absent(name)


def is_blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == ""


def blank(table: str, column: str, id_: str = "id") -> Rule:
    """Rows whose column is null or blank."""
    return lambda t: t[table].filter(is_blank(column)).select(F.col(id_).cast("string").alias("id"))


def outside(table: str, column: str, allowed: list[str], id_: str = "id") -> Rule:
    """Rows whose (non-null) column is none of the allowed values."""
    return lambda t: t[table].filter(~F.col(column).isin(allowed)).select(F.col(id_).cast("string").alias("id"))


def where(table: str, condition: str, id_: str = "id") -> Rule:
    """Rows that meet an SQL condition."""
    return lambda t: t[table].filter(condition).select(F.col(id_).cast("string").alias("id"))


def orphan(table: str, column: str, parent: str, key: str, id_: str = "id") -> Rule:
    """Rows whose non-blank column has no partner in the parent table: an anti-join."""
    return lambda t: t[table].filter(~is_blank(column)).join(t[parent].select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti").select(F.col(id_).cast("string").alias("id"))


def duplicated(table: str, id_: str = "id") -> Rule:
    """Ids that stand in more than one row."""
    return lambda t: t[table].groupBy(F.col(id_).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")


def mismatch(table: str, column: str, parent: str, key: str, mine: str, theirs: str, id_: str = "id") -> Rule:
    """Rows whose own value differs from that of their parent."""
    def run(t: Tables) -> DataFrame:
        p = t[parent].select(F.col(key).alias("__key"), F.col(theirs).alias("__theirs"))
        return t[table].join(p, F.col(column) == F.col("__key")).filter(~F.col(mine).eqNullSafe(F.col("__theirs"))).select(F.col(id_).cast("string").alias("id"))

    return run


def shared(table: str, column: str, *others: str) -> Rule:
    """Values of the column that stand under more than one value of each of the other columns."""
    def run(t: Tables) -> DataFrame:
        grouped = t[table].filter(~is_blank(column)).groupBy(F.col(column).cast("string").alias("id")).agg(*(F.countDistinct(c).alias(f"n{i}") for i, c in enumerate(others)))
        for i in range(len(others)):
            grouped = grouped.filter(F.col(f"n{i}") > 1)
        return grouped.select("id")

    return run


def empty(table: str, needed_by: str | None = None) -> Rule:
    """One row if the table is empty (while the table that needs it is not)."""
    def run(t: Tables) -> DataFrame:
        n = t[table].agg(F.count(F.lit(1)).alias("n"))
        if needed_by:
            n = n.crossJoin(t[needed_by].agg(F.count(F.lit(1)).alias("m"))).filter("m > 0")  # one row each
        return n.filter("n = 0").select(F.lit(table).alias("id"))

    return run


def unreviewed(table: str, condition: str, decisions: str = "decisions", id_: str = "id") -> Rule:
    """Rows that meet the condition and have no review decision."""
    return lambda t: t[table].filter(condition).join(t[decisions].select(F.col("artifact_id").alias("__key")), F.col(id_).cast("string") == F.col("__key"), "left_anti").select(F.col(id_).cast("string").alias("id"))


def lint(tables: Tables, checks: list[Check]) -> DataFrame:
    """All findings: code, severity, gate, id, message; rules whose table is absent are left out. Without any table it is an error."""
    if not tables:
        raise ValueError("a run has at least one table")
    found = next(iter(tables.values())).sparkSession.createDataFrame([], "code string, severity string, gate string, id string, message string")
    for c in checks:
        try:
            rows = c.broken(Given(tables))
        except Absent:
            continue
        found = found.unionByName(rows.select(F.lit(c.code).alias("code"), F.lit(c.severity).alias("severity"), F.lit(c.gate).alias("gate"), "id", F.concat(F.lit(c.message + ": "), F.coalesce("id", F.lit("unknown"))).alias("message")))
    return found


def gates(findings: DataFrame, gate_names: DataFrame) -> DataFrame:
    """Each gate with its errors, warnings, affected ids, first message and status; gate_names: gate."""
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    counts = findings.groupBy("gate").agg(errors.alias("errors"), warnings.alias("warnings"), F.countDistinct("id").alias("affected"), F.min("message").alias("message"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    status = F.when(zero("errors") > 0, "fail").when(zero("warnings") > 0, "pass_with_warnings").otherwise("pass")
    return gate_names.join(counts, "gate", "left").select("gate", status.alias("status"), zero("errors").alias("errors"), zero("warnings").alias("warnings"), zero("affected").alias("affected"), "message")


#: What enumerated columns may hold.
CATEGORIES = ["obligation", "institutional", "documentary", "conditional", "oversight", "record_keeping", "reporting"]
METHODS, CONFIDENCES = ["deterministic", "llm", "manual", "fallback"], ["high", "medium", "low"]
EXTRACTION_METHODS = ["heuristic", "llm", "manual", "imported", "fallback"]
FRAGMENT_TYPES = ["article", "regulation", "section", "recital", "annex", "schedule", "document", "chunk", "heading", "paragraph", "table", "unknown"]
LINK_TYPES = ["is_target", "amends", "implements", "supplements", "corrects", "explains", "evidences", "contains_annex_to", "references", "contextual", "unknown"]
GROUNDED = ["proposition_text", "source_fragment_text", "legal_subject", "affected_subjects", "required_documents", "conditions"]
LEGAL_ROLES = ["base_act", "amendment", "delegated_act", "implementing_act", "certificate_model", "annex", "corrigendum"]
SOURCE_ROLES = [*LEGAL_ROLES, "guidance", "explanatory_material", "case_file", "unknown"]
RELATIONSHIPS = ["analysis_target", "modifies_target", "implements_target", "explains_target", "evidences_target", "contextual_source", "unknown"]
RELEVANCES, INHERITANCES = ["direct", "indirect", "contextual"], ["explicit", "inherited", "inferred", "none"]

#: The rules over a run's tables; the tables go by the names of the relations.
RUN_CHECKS = [
    Check("L1", "error", "overrides", "override of an unsupported artifact_type", lambda t: override_faults(t["decisions"], t["artefacts"]).filter("rule = 'L1'").select("id")),
    Check("L2", "error", "overrides", "override references missing artifact", lambda t: override_faults(t["decisions"], t["artefacts"]).filter("rule = 'L2'").select("id")),
    Check("L3", "error", "overrides", "invalid override replacement", lambda t: override_faults(t["decisions"], t["artefacts"]).filter("rule = 'L3'").select("id")),
    Check("L4", "error", "artifacts", "run_artifact missing content_hash", blank("run_artifacts", "content_hash")),
    Check("L5", "error", "propositions", "proposition missing source_record_id", blank("propositions", "source_record_id")),
    Check("L6", "error", "propositions", "orphan proposition source_record_id", orphan("propositions", "source_record_id", "sources", "id")),
    Check("L7", "error", "propositions", "proposition missing source_snapshot_id", blank("propositions", "source_snapshot_id")),
    Check("L8", "error", "propositions", "proposition source_snapshot_id not found", orphan("propositions", "source_snapshot_id", "snapshots", "id")),
    Check("L9", "error", "propositions", "proposition references missing source fragment", orphan("propositions", "source_fragment_id", "fragments", "id")),
    Check("L10", "error", "propositions", "proposition references mismatched fragment/snapshot", mismatch("propositions", "source_fragment_id", "fragments", "id", "source_snapshot_id", "source_snapshot_id")),
    Check("L11", "error", "propositions", "invalid proposition category", lambda t: t["propositions"].select("id", F.explode("categories").alias("c")).filter(~F.col("c").isin(CATEGORIES)).select(F.col("id").cast("string").alias("id"))),
    Check("L12", "warning", "legacy", "proposition_extraction_traces missing or empty", empty("traces", "propositions")),
    Check("L13", "error", "traces", "duplicate extraction trace id", duplicated("traces")),
    Check("L14", "error", "traces", "proposition missing extraction trace", orphan("propositions", "id", "traces", "proposition_id")),
    Check("L15", "error", "traces", "extraction trace references missing proposition", orphan("traces", "proposition_id", "propositions", "id")),
    Check("L16", "error", "traces", "extraction trace invalid extraction_method", outside("traces", "extraction_method", EXTRACTION_METHODS)),
    Check("L17", "error", "traces", "extraction trace fallback without reason", where("traces", "extraction_method = 'fallback' AND coalesce(trim(reason), '') = ''")),
    Check("L18", "warning", "traces", "extraction trace low confidence", where("traces", "confidence = 'low'")),
    Check("L19", "warning", "traces", "low-confidence extraction trace without decision", unreviewed("traces", "confidence = 'low'")),
    Check("L20", "warning", "traces", "extraction trace missing evidence_text", blank("traces", "evidence_text")),
    Check("L21", "warning", "traces", "extraction trace missing evidence_locator", blank("traces", "evidence_locator")),
    Check("L22", "error", "traces", "extraction trace source_record_id not found", orphan("traces", "source_record_id", "sources", "id")),
    Check("L23", "error", "traces", "extraction trace source_snapshot_id not found", orphan("traces", "source_snapshot_id", "snapshots", "id")),
    Check("L24", "error", "traces", "extraction trace source_fragment_id not found", orphan("traces", "source_fragment_id", "fragments", "id")),
    Check("L25", "error", "traces", "extraction trace references mismatched fragment/snapshot", mismatch("traces", "source_fragment_id", "fragments", "id", "source_snapshot_id", "source_snapshot_id")),
    Check("L26", "error", "inventory", "source_inventory rows are missing", empty("inventory")),
    Check("L27", "warning", "fetch", "source_fetch_metadata missing", orphan("sources", "id", "fetch_metadata", "source_record_id")),
    Check("L28", "error", "fetch", "fetched source has no fetch attempt", lambda t: orphan("fetched", "id", "fetch_attempts", "source_record_id")(Given({**t, "fetched": t["sources"].filter(~is_blank("source_url"))}))),
    Check("L29", "warning", "snapshots", "snapshot parser metadata missing", where("snapshots", "coalesce(trim(parser_name), '') = '' OR coalesce(trim(parser_version), '') = ''")),
    Check("L30", "error", "fragments", "source fragment has no source_record_id", blank("fragments", "source_record_id")),
    Check("L31", "error", "fragments", "source fragment source_record_id not found", orphan("fragments", "source_record_id", "sources", "id")),
    Check("L32", "error", "fragments", "source fragment has no source_snapshot_id", blank("fragments", "source_snapshot_id")),
    Check("L33", "error", "fragments", "source fragment source_snapshot_id not found", orphan("fragments", "source_snapshot_id", "snapshots", "id")),
    Check("L34", "error", "fragments", "source fragment has no text hash", blank("fragments", "text_hash")),
    Check("L35", "warning", "fragments", "source fragment fragment_type unknown", outside("fragments", "fragment_type", FRAGMENT_TYPES)),
    Check("L36", "warning", "fragments", "source fragment fragment_type is unknown", where("fragments", "fragment_type = 'unknown'")),
    Check("L37", "warning", "fragments", "source fragment locator missing", blank("fragments", "locator")),
    Check("L38", "warning", "fragments", "duplicate source fragment id exists", duplicated("fragments")),
    Check("L39", "warning", "parse", "parse trace missing for snapshot with fragments", lambda t: orphan("f", "source_snapshot_id", "parse_traces", "source_snapshot_id", "source_snapshot_id")(Given({**t, "f": t["fragments"].select("source_snapshot_id").distinct()}))),
    Check("L40", "warning", "parse", "parse trace status failed but fragments exist", lambda t: t["parse_traces"].filter("status = 'failed'").join(t["fragments"].select("source_snapshot_id"), "source_snapshot_id", "left_semi").select(F.col("source_snapshot_id").alias("id"))),
    Check("L41", "error", "fetch", "successful fetch/cache_hit has no content_hash", where("fetch_attempts", "status IN ('success', 'cache_hit') AND coalesce(content_hash, '') = ''", "source_record_id")),
    Check("L42", "warning", "fetch", "successful fetch/cache_hit has no raw_artifact_uri", where("fetch_attempts", "status IN ('success', 'cache_hit') AND coalesce(raw_artifact_uri, '') = ''", "source_record_id")),
    Check("L43", "warning", "lineage", "duplicate content_hash appears under multiple sources", shared("sources", "content_hash", "id", "citation")),
    Check("L44", "warning", "lineage", "sources share content_hash and current_snapshot_id", lambda t: t["sources"].groupBy("content_hash", "current_snapshot_id").agg(F.countDistinct("id").alias("n")).filter("n > 1 AND content_hash <> ''").select(F.col("current_snapshot_id").alias("id"))),
    Check("L45", "error", "categorisation", "source categorisation rationale has invalid method", outside("rationales", "method", METHODS, "source_record_id")),
    Check("L46", "error", "categorisation", "source categorisation rationale has invalid confidence", outside("rationales", "confidence", CONFIDENCES, "source_record_id")),
    Check("L47", "warning", "categorisation", "source categorisation confidence low", where("rationales", "confidence = 'low'", "source_record_id")),
    Check("L48", "warning", "categorisation", "low-confidence categorisation without decision", unreviewed("rationales", "confidence = 'low'", id_="source_record_id")),
    Check("L49", "error", "categorisation", "source categorisation fallback missing reason", where("rationales", "method = 'fallback' AND coalesce(trim(reason), '') = ''", "source_record_id")),
    Check("L50", "error", "categorisation", "source categorisation fallback missing evidence", where("rationales", "method = 'fallback' AND coalesce(size(evidence), 0) <= 0", "source_record_id")),
    Check("L51", "error", "links", "source target link has invalid link_type", outside("links", "link_type", LINK_TYPES, "source_record_id")),
    Check("L52", "error", "links", "source target link has invalid confidence", outside("links", "confidence", CONFIDENCES, "source_record_id")),
    Check("L53", "warning", "links", "source target link unknown", where("links", "link_type = 'unknown'", "source_record_id")),
    Check("L54", "warning", "links", "source target link confidence low", where("links", "confidence = 'low'", "source_record_id")),
    Check("L55", "warning", "links", "low-confidence source target link without decision", unreviewed("links", "confidence = 'low'")),
    Check("L56", "error", "links", "unknown source target link missing reason", where("links", "link_type = 'unknown' AND coalesce(trim(reason), '') = ''", "source_record_id")),
    Check("L57", "error", "links", "unknown source target link missing evidence", where("links", "link_type = 'unknown' AND coalesce(size(evidence), 0) <= 0", "source_record_id")),
    Check("L58", "warning", "links", "rejected source_target_link still referenced by source_inventory", lambda t: t["links"].join(t["decisions"].filter("decision = 'rejected'").select(F.col("artifact_id").alias("id")), "id", "left_semi").join(t["inventory"].select("source_record_id"), "source_record_id", "left_semi").select("id")),
    Check("L59", "error", "inventory", "source_inventory row missing content_hash", blank("inventory", "content_hash")),
    Check("L60", "error", "inventory", "source_inventory row missing source_record_id", blank("inventory", "source_record_id")),
    Check("L61", "error", "inventory", "source_inventory invalid source_role", outside("inventory", "source_role", SOURCE_ROLES)),
    Check("L62", "error", "inventory", "source_inventory invalid relationship_to_analysis", outside("inventory", "relationship_to_analysis", RELATIONSHIPS)),
    Check("L63", "error", "inventory", "source_inventory row missing source_target_link", orphan("inventory", "source_record_id", "links", "source_record_id")),
    Check("L64", "warning", "inventory", "source_inventory row has unknown target link", lambda t: t["inventory"].join(t["links"].filter("link_type = 'unknown'").select("source_record_id"), "source_record_id", "left_semi").select("id")),
    Check("L65", "error", "inventory", "source_inventory row has role/relationship without rationale", orphan("inventory", "source_record_id", "rationales", "source_record_id")),
    Check("L66", "error", "inventory", "non-target legal source has unknown link without reason/evidence", lambda t: t["inventory"].filter(F.col("source_role").isin(LEGAL_ROLES)).join(t["links"].filter("link_type = 'unknown' AND (coalesce(trim(reason), '') = '' OR coalesce(size(evidence), 0) <= 0)").select("source_record_id"), "source_record_id", "left_semi").select("id")),
    Check("L67", "warning", "inventory", "source_inventory role unknown", where("inventory", "source_role = 'unknown'")),
    Check("L68", "warning", "inventory", "source_inventory relationship unknown", where("inventory", "relationship_to_analysis = 'unknown'")),
    Check("L69", "warning", "inventory", "source_inventory row missing optional source_url", blank("inventory", "source_url")),
    Check("L70", "warning", "inventory", "source_inventory row missing optional version/consolidation date", where("inventory", "coalesce(version_id, '') = '' AND consolidation_date IS NULL")),
    Check("L71", "error", "divergence", "divergence observation missing primary evidence", where("observations", "divergence_type <> 'none' AND coalesce(primary_source_fragment_id, '') = ''")),
    Check("L72", "error", "divergence", "divergence observation missing comparator evidence", where("observations", "divergence_type <> 'none' AND coalesce(comparator_source_fragment_id, '') = ''")),
    Check("L73", "warning", "traces", "rejected extraction trace still used by a proposition", lambda t: t["traces"].join(t["decisions"].filter("decision = 'rejected'").select(F.col("artifact_id").alias("id")), "id", "left_semi").join(t["decisions"].filter("decision IN ('approved', 'overridden')").select(F.col("artifact_id").alias("proposition_id")), "proposition_id", "left_anti").select("id")),
    Check("L74", "error", "completeness", "suggested statement present but raw text missing", lambda t: t["assessments"].filter("coalesce(suggested, '') <> ''").join(t["propositions"].filter(~is_blank("proposition_text")).select(F.col("id").alias("proposition_id")), "proposition_id", "left_anti").select(F.col("proposition_id").alias("id"))),
    Check("L75", "warning", "completeness", "fragmentary proposition has no decision", unreviewed("assessments", "status = 'fragmentary'", id_="proposition_id")),
    Check("L76", "warning", "completeness", "context_dependent proposition has no suggested statement", where("assessments", "status = 'context_dependent' AND coalesce(trim(suggested), '') = ''", "proposition_id")),
    Check("L77", "error", "scopes", "proposition_scope_links present without legal_scopes", empty("scopes", "scope_links")),
    Check("L78", "error", "scopes", "proposition_scope_link references invalid scope_id", orphan("scope_links", "scope_id", "scopes", "id")),
    Check("L79", "error", "scopes", "proposition_scope_link references missing proposition", orphan("scope_links", "proposition_id", "propositions", "id")),
    Check("L80", "error", "scopes", "proposition_scope_link invalid method", outside("scope_links", "method", METHODS)),
    Check("L81", "error", "scopes", "proposition_scope_link invalid relevance", outside("scope_links", "relevance", RELEVANCES)),
    Check("L82", "error", "scopes", "proposition_scope_link invalid inheritance", outside("scope_links", "inheritance", INHERITANCES)),
    Check("L83", "error", "scopes", "proposition_scope_link invalid confidence", outside("scope_links", "confidence", CONFIDENCES)),
    Check("L88", "warning", "scopes", "proposition_scope_link direct applicability without grounded evidence", lambda t: t["scope_links"].filter("method = 'deterministic' AND relevance = 'direct'").filter(~F.coalesce(F.col("evidence_field").isin(GROUNDED), F.lit(False))).select("id") if "evidence_field" in t["scope_links"].columns else t["scope_links"].filter("false").select("id")),
    Check("L89", "warning", "scopes", "contextual low explicit link without review candidate", lambda t: t["scope_links"].filter("relevance = 'contextual' AND confidence = 'low' AND inheritance = 'explicit'").join(t["scope_candidates"].select("proposition_id", "scope_id"), ["proposition_id", "scope_id"], "left_anti").select("id")),
    Check("L84", "warning", "scopes", "proposition_scope_link targets deprecated scope", lambda t: t["scope_links"].join(t["scopes"].filter("status = 'deprecated'").select(F.col("id").alias("scope_id")), "scope_id", "left_semi").select(F.col("id").cast("string").alias("id"))),
    Check("L85", "warning", "scopes", "proposition_scope_link confidence low", where("scope_links", "confidence = 'low' AND relevance = 'direct'")),
    Check("L86", "error", "scopes", "proposition_scope_link fallback missing reason", where("scope_links", "method = 'fallback' AND coalesce(trim(reason), '') = ''")),
    Check("L87", "error", "scopes", "proposition_scope_link fallback missing evidence", where("scope_links", "method = 'fallback' AND coalesce(size(evidence), 0) <= 0")),
]

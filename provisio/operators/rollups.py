"""Roll-ups of a run: extraction traces built from notes, and their metrics; job metrics; gates and ids of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Names, messages, stage titles and gates of the rules of record, in their order.
HEURISTIC_NOTE = "heuristic extraction"
FELL_BACK = "LLM extraction did not return propositions for this source; heuristic selection applied."
NO_QUOTE = "Evidence quote could not be matched exactly to source text (verbatim span unavailable)."
REASONS = {
    "classified": {"fallback": "Heuristic normative sentence selection after the LLM extraction path did not produce usable rows.", "llm": "Structured LLM JSON extraction from source text.", "heuristic": "Normative sentence selection over parsed source fragments."},
    "traced": {"fallback": "Heuristic fallback after model path (trace metadata).", "llm": "Model-assisted extraction (trace metadata).", "heuristic": "Normative sentence selection over parsed source fragments."},
}
STAGES = [
    ("Loading case", "loading_case"), ("Source intake", "source_intake"), ("Source parsing", "source_parsing"), ("Source fragmentation", "source_fragmentation"), ("Proposition extraction", "proposition_extraction"), ("Proposition inventory", "proposition_inventory"),
    ("Divergence comparison", "divergence_comparison"), ("Scope linking", "scope_linking"), ("Completeness assessment", "completeness_assessment"), ("Export bundle", "export_bundle"), ("Lint / quality summary", "run_quality"),
]
GATES = [
    ("run_artifacts", ["run_artifact missing content_hash"]), ("proposition_extraction_traces", ["extraction trace", "proposition missing extraction trace", "duplicate extraction trace"]), ("propositions", ["proposition "]), ("source_inventory", ["source_inventory"]),
    ("source_categorisation", ["source categorisation"]), ("source_target_links", ["source target link"]), ("source_fetch", ["fetched source has no fetch", "successful fetch", "fetch/cache_hit", "source_fetch_metadata"]), ("source_snapshots", ["snapshot parser metadata"]), ("source_fragments", ["source fragment", "duplicate source fragment"]),
    ("source_parse_traces", ["parse trace"]), ("divergence_observations", ["divergence observation"]), ("content_lineage", ["duplicate content_hash"]), ("legacy_compatibility", ["legacy bundle"]), ("legal_scopes", ["proposition_scope_link", "invalid scope_id"]),
]
RELEVANCE = ["unknown", "none", "contextual", "indirect", "direct"]
#: What a model's extraction leaves in the notes of a proposition, as JSON.
META = "extraction_mode string, fallback_used boolean, validation_errors array<string>, model_confidence string, trace_warnings array<string>, evidence_quote string, prompt_version string, model_alias string, fallback_policy string, schema_version string"


def stage_of(title: Column) -> Column:
    """The stage that a progress title begins with, or null."""
    t = F.trim(title)
    return F.coalesce(*(F.when(F.startswith(t, F.lit(prefix)), stage) for prefix, stage in STAGES))


def affected_id(message: Column) -> Column:
    """The id that a message names behind its last colon (in brackets at the end, if there are any), or null."""
    tail = F.trim(F.substring_index(message, ":", -1))
    bracket = F.trim(F.regexp_extract(tail, r"\(([^)]+)\)\s*$", 1))
    inner = F.when(bracket != "", bracket).otherwise(tail)
    named = F.when(inner.rlike(r"^[\w\-]+$"), inner).when(F.length(tail) <= 120, tail)
    return F.when(F.contains(message, F.lit(":")) & (tail != "") & ~F.startswith(tail, F.lit("http")), named)


def gate_of(message: Column, gates: list[tuple[str, list[str]]] = GATES) -> Column:
    """The first gate one of whose needles the message holds, letter case aside; else "general"."""
    low = F.lower(message)
    hit = [F.when(T.any_in(low, needles), gate) for gate, needles in gates]
    return F.coalesce(*hit, F.lit("general"))


def extraction_traces(props: DataFrame, use_llm: bool, prompt: tuple[str, str] = ("extract.propositions.default", "v2"), strategy: str = "v1", carry: list[str] | None = None) -> DataFrame:
    """A trace for each proposition: how it was extracted, by what, how sure, with what warnings.

    props: id, proposition_text, notes, meta (JSON text or null), review_status, fragment_locator, article_reference.
    Returns trace_id, id, method, extractor, prompt_id, prompt_version, rule_id, confidence, reason, warnings, errors,
    validation_errors, status, evidence_text, evidence_locator, fallback_used, and the columns of props named by carry. Meta that
    is no JSON object counts as none.
    """
    meta = F.from_json("meta", META)
    rows = props.withColumn("m", F.when(F.substring(F.trim("meta"), 1, 1) == "{", meta))
    has = F.col("m").isNotNull()
    none = F.array().cast("array<string>")
    fell = F.coalesce("m.fallback_used", F.lit(False))
    noted = F.coalesce(F.trim("notes"), F.lit("")) == HEURISTIC_NOTE
    traced = F.when(F.col("m.extraction_mode") == "heuristic", "heuristic").when(fell, "fallback").otherwise("llm")
    classified = F.when(noted & F.lit(use_llm), "fallback").when(noted | F.lit(not use_llm), "heuristic").otherwise("llm")
    rows = rows.withColumns({"method": F.when(has, traced).otherwise(classified), "validation_errors": F.filter(F.coalesce("m.validation_errors", none), lambda e: F.trim(e) != "")})
    method, wrong = F.col("method"), F.size("validation_errors") > 0
    of = lambda table: F.coalesce(*(F.when(method == m, v) for m, v in table.items()))
    sure = F.lower(F.trim("m.model_confidence"))
    plain = F.when(method == "fallback", "low").otherwise("medium")
    confidence = F.when(has & (fell | (F.col("review_status") == "needs_review")), "low").when(has & (method == "llm"), F.when(sure.isin("high", "low"), sure).otherwise("medium")).otherwise(plain)
    unquoted = has & (method == "llm") & (F.trim("m.evidence_quote") == "")
    warnings = F.coalesce("m.trace_warnings", none)
    warnings = F.when(unquoted & ~F.array_contains(warnings, NO_QUOTE), F.concat(warnings, F.array(F.lit(NO_QUOTE)))).when(~has & (method == "fallback"), F.array(F.lit(FELL_BACK))).otherwise(warnings)
    empty = F.coalesce(F.trim("proposition_text"), F.lit("")) == ""
    extractor = F.when(method == "fallback", "extract.heuristic_fallback").when((method == "llm") & has, "extract.model_json_v2").when(method == "llm", "extract.llm_json").otherwise("extract.heuristic")
    place = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col(c))
    return rows.select(
        F.concat(F.lit("trace:"), T.short_hash(F.col("id"))).alias("trace_id"), "id", "method", extractor.alias("extractor"), F.when(method != "heuristic", prompt[0]).alias("prompt_id"), F.when(method != "heuristic", F.coalesce(place("m.prompt_version"), F.lit(prompt[1]))).alias("prompt_version"), F.when(method != "llm", "extract.heuristic.normative_sentences").alias("rule_id"), F.lit(strategy).alias("rule_version"),
        confidence.alias("confidence"), F.when(has & wrong, F.array_join("validation_errors", "; ")).when(has, of(REASONS["traced"])).otherwise(of(REASONS["classified"])).alias("reason"), warnings.alias("warnings"), F.when(empty, F.array(F.lit("empty proposition_text"))).otherwise(none).alias("errors"), "validation_errors",
        F.when(empty, "failed").when(wrong, "partial_success").otherwise("success").alias("status"), F.coalesce(F.when(has, F.col("m.evidence_quote")), "proposition_text").alias("evidence_text"), F.coalesce(place("fragment_locator"), place("article_reference")).alias("evidence_locator"), F.when(has, fell).alias("fallback_used"), *(carry or []),
    )


def trace_metrics(traces: DataFrame) -> DataFrame:
    """One row: counts of traces by method, of warnings and errors in them, of fallbacks and low confidence."""
    by = {m: F.count_if(F.col("method") == m).alias(f"{m}_count") for m in ("heuristic", "llm", "manual", "imported", "fallback")}
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return traces.agg(F.count(F.lit(1)).alias("traced_count"), *by.values(), total("warnings").alias("warning_count"), total("errors").alias("error_count"), F.count_if(F.col("fallback_used")).alias("fallback_used_count"), F.count_if(F.lower("confidence") == "low").alias("low_confidence_count"))


def call_summary(calls: DataFrame, keys: list[str] | None = None, more: list[Column] | None = None) -> DataFrame:
    """Counts over traces of model calls (of each key, or in all), and the place of the largest call, the first at a tie.

    more: aggregates that the same pass is to return besides.

    calls: ord, llm_invoked, skipped_llm, skip_reason, estimated_input_tokens, fragment_locator, source_record_id. One
    pass: the largest call is kept as a struct ordered by tokens, then by the earliest ord. Estimates that are
    not above zero don't count; blank places are null.
    """
    tokens = F.when(F.col("estimated_input_tokens") > 0, F.col("estimated_input_tokens"))
    place = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.trim(c))
    largest = F.min(F.when(tokens.isNotNull(), F.struct((-tokens).alias("less"), F.col("ord"), place("fragment_locator").alias("locator"), place("source_record_id").alias("source"))))
    counts = [F.count_if(F.col("llm_invoked")).alias("llm_extraction_call_count"), F.count_if(F.col("skipped_llm")).alias("llm_extraction_skipped_count"), F.count_if(F.col("skip_reason") == "context_window_risk").alias("context_window_risk_count"), F.coalesce(F.sum(tokens), F.lit(0)).alias("estimated_input_tokens"), largest.alias("__l"), *(more or [])]
    found = calls.groupBy(*keys).agg(*counts) if keys else calls.agg(*counts)
    return found.select(*(keys or []), *(c for c in found.columns if c not in {"__l", *(keys or [])}), (-F.col("__l.less")).alias("max_estimated_input_tokens"), F.col("__l.locator").alias("largest_fragment_locator"), F.col("__l.source").alias("largest_source_record_id"))


def calls_of_stages(stages: DataFrame) -> DataFrame:
    """The call traces nested in the inputs of a run's first stage "proposition extraction", one row each, with ord.

    stages: run_id, position, stage_name, inputs (JSON text with extraction_mode and extraction_llm_call_traces), and part where
    the inputs of a long stage stand in several rows, each with the next calls. Every row is parsed by itself, so no
    task needs all calls of a run at once; ord goes on from part to part.
    """
    call = "struct<llm_invoked:boolean,skipped_llm:boolean,skip_reason:string,estimated_input_tokens:long,fragment_locator:string,source_record_id:string>"
    named = stages.filter("stage_name = 'proposition extraction'")
    if "part" in stages.columns:
        first = named.groupBy("run_id").agg(F.min("position").alias("position"))
        named = named.join(first, ["run_id", "position"]).select("run_id", F.col("part").cast("long").alias("part"), "inputs")
    else:
        named = named.groupBy("run_id").agg(F.min_by("inputs", "position").alias("inputs")).select("run_id", F.lit(0).cast("long").alias("part"), "inputs")
    inputs = F.from_json("inputs", f"extraction_mode string, extraction_llm_call_traces array<{call}>")
    rows = named.withColumn("i", inputs).select("run_id", "part", F.col("i.extraction_mode").alias("extraction_mode"), F.posexplode_outer("i.extraction_llm_call_traces").alias("at", "c"))
    return rows.select("run_id", "extraction_mode", (F.col("part") * 2**32 + F.col("at")).alias("ord"), "c.*")


def job_metrics(runs: DataFrame, calls: DataFrame, traces: DataFrame, props: DataFrame) -> DataFrame:
    """Metrics of each run: those that its quality summary states, else those counted from its relations.

    runs: run_id, status, source_count, proposition_count, warning_count, llm_extraction_call_count (nulls and zeros fall back); calls: of
    calls_of_stages(); traces: run_id, confidence, fallback_used; props: run_id. job_status: fail, warning or pass.
    """
    # A run without calls has one row of nulls, which counts nothing but may state the mode.
    summary = call_summary(calls, ["run_id"], [F.first("extraction_mode", True).alias("extraction_mode")]).withColumnRenamed("llm_extraction_call_count", "__calls")
    sure = traces.groupBy("run_id").agg(F.count_if(F.col("fallback_used")).alias("fallback_count"), F.count_if(F.lower("confidence") == "low").alias("low_confidence_count"))
    counted = props.groupBy("run_id").agg(F.count(F.lit(1)).alias("__props"), F.countDistinct("source_record_id").alias("__sources"))
    rows = runs.join(summary, "run_id", "left").join(sure, "run_id", "left").join(counted, "run_id", "left")
    stated = lambda a, b: F.coalesce(F.when(F.col(a) != 0, F.col(a)), F.col(b), F.lit(0)).cast("long").alias(a)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    low = F.lower(F.trim("status"))
    return rows.select(
        "run_id", F.coalesce(F.when(F.trim("extraction_mode") != "", F.trim("extraction_mode")), F.lit("unknown")).alias("extraction_mode"), stated("source_count", "__sources"), stated("proposition_count", "__props"), stated("llm_extraction_call_count", "__calls"), zero("llm_extraction_skipped_count"), zero("context_window_risk_count"), "max_estimated_input_tokens",
        "largest_fragment_locator", zero("fallback_count"), zero("low_confidence_count"), zero("warning_count"), F.when(low == "fail", "fail").when(low == "pass_with_warnings", "warning").otherwise("pass").alias("job_status"),
    )


def strongest_relevance(links: DataFrame, scope: str) -> DataFrame:
    """id, relevance: the strongest relevance of a scope for each row that has links; "unknown" without a known one."""
    said = F.lower(F.trim("relevance"))
    rank = F.when(F.col("scope_id") == scope, F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, RELEVANCE)), said), F.lit(0)) - 1, F.lit(0))).otherwise(0)
    best = links.groupBy("id").agg(F.max(rank).cast("int").alias("r"))
    return best.select("id", F.element_at(F.array(*map(F.lit, RELEVANCE)), F.col("r") + 1).alias("relevance"))


def warnings_by_gate(messages: DataFrame) -> DataFrame:
    """gate, n: warnings by what stands before their first colon, "general" without one."""
    gate = F.when(F.contains("message", F.lit(":")), F.trim(F.substring_index("message", ":", 1))).otherwise("general")
    return messages.groupBy(gate.alias("gate")).agg(F.count(F.lit(1)).alias("n"))

"""Queries over a run's records and roll-ups, with the DuckDB SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as N
from ..operators import rollups as R

_EVENTS = {"events": "events"}


def _rows(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return spark.sql(query, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _s(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


# --- findings --------------------------------------------------------------------------------------------------------
_ASSESS = f"""SELECT event_id AS ord, 'as-' || {_s("event_id")} AS id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN ' ' ELSE 'finding-' || {_s("user_id % 31")} END AS finding_id, 'prop-' || {_s("user_id % 41")} AS proposition_id, 'prop-' || {_s("event_id % 43")} AS comparator_proposition_id,
 'EU' AS jurisdiction_a, CASE WHEN event_id % 3 = 0 THEN 'UK' ELSE 'FR' END AS jurisdiction_b, {{checked}} AS sources_checked FROM {{events}}"""
_CHECKED = [f"'src-' || {_s('user_id % 12')}", f"'src-' || {_s('event_id % 14')}", "'src-gone'"]
_ASSESS_SPARK = _ASSESS.format(checked="CASE WHEN event_id % 9 = 0 THEN CAST(array() AS array<string>) ELSE array(" + ", ".join(_CHECKED) + ") END", events="{events}")
_ASSESS_DUCK = _ASSESS.format(checked="CASE WHEN event_id % 9 = 0 THEN []::VARCHAR[] ELSE [" + ", ".join(_CHECKED) + "] END", events="events")
_SOURCES = f"""SELECT user_id % 13 AS ord, 'src-' || {_s("user_id % 13")} AS id, CASE WHEN user_id % 13 = 3 THEN '' ELSE 'snap-' || {_s("user_id % 13")} END AS current_snapshot_id, CASE WHEN user_id % 13 IN (5, 6) THEN NULL ELSE '2026-0' || {_s("1 + user_id % 13 % 9")} || '-01' END AS as_of_date,
 'Title ' || {_s("user_id % 13")} AS title, CASE WHEN user_id % 13 % 4 = 0 THEN '' ELSE 'Reg ' || {_s("user_id % 13")} END AS citation, CASE WHEN user_id % 13 % 3 = 0 THEN NULL ELSE 'http://law/' || {_s("user_id % 13")} END AS source_url, '2026-02-01' AS retrieved_at, CASE WHEN user_id % 13 % 5 = 0 THEN '' ELSE 'hash-' || {_s("user_id % 13")} END AS content_hash,
 CASE WHEN user_id % 13 % 2 = 0 THEN 'EU' ELSE '' END AS jurisdiction, 'regulation' AS kind, 'working' AS status, CASE WHEN user_id % 13 = 7 THEN 'eu/' || {_s("user_id % 13")} ELSE '' END AS instrument_id, CASE WHEN user_id % 13 % 6 = 1 THEN 'token-' || {_s("user_id % 13")} END AS family_token, user_id % 13 IN (4, 9) AS is_target_source FROM {{events}} GROUP BY user_id % 13"""
_FRAGMENTS = f"SELECT event_id AS ord, 'frag-' || {_s('event_id')} AS id, 'src-' || {_s('user_id % 11')} AS source_record_id FROM {{events}} WHERE event_id % 4 = 0"
_PROPS = f"SELECT 'prop-' || {_s('user_id % 41')} AS id, 'src-' || {_s('user_id % 41 % 15')} AS source_record_id, CASE WHEN user_id % 41 % 3 = 0 THEN 'own-' || {_s('user_id % 41')} WHEN user_id % 41 % 3 = 1 THEN '' END AS source_fragment_id FROM {{events}} GROUP BY user_id % 41"
_TRACES = f"SELECT 'src-' || {_s('user_id % 12')} AS source_record_id, 'authority' AS authority, CASE WHEN user_id % 12 = 2 THEN '' ELSE 'celex-' || {_s('user_id % 12')} END AS authority_source_id, CASE WHEN user_id % 12 % 3 = 0 THEN NULL ELSE 'fetched' END AS fetch_status, CASE WHEN user_id % 12 % 2 = 0 THEN 'cache_hit' ELSE '' END AS decision, 'trace-hash' AS content_hash, '' AS cache_key, 'v1' AS version_id FROM {{events}} GROUP BY user_id % 12"


def _findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return N.findings_and_observations(_rows(spark, sf_dir, _ASSESS_SPARK), *(_rows(spark, sf_dir, q.format(events="{events}")) for q in (_SOURCES, _FRAGMENTS, _PROPS)))


def divergence_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all assessments."""
    return _findings(spark, sf_dir)[0]


def divergence_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of all assessments with the fragments that bear them out."""
    return _findings(spark, sf_dir)[1]


def source_fetch_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch metadata of the sources that have a trace."""
    return N.fetch_metadata(_rows(spark, sf_dir, _SOURCES.format(events="{events}")), _rows(spark, sf_dir, _TRACES.format(events="{events}")))


def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources with their fetch metadata and the primary target."""
    sources = _rows(spark, sf_dir, _SOURCES.format(events="{events}"))
    return N.source_inventory(sources, N.fetch_metadata(sources, _rows(spark, sf_dir, _TRACES.format(events="{events}"))))


def source_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propositions counted by the family and jurisdiction of their source; unknown and missing sources stand by themselves."""
    rows = _rows(spark, sf_dir, f"SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN NULL ELSE 'src-' || {_s('user_id % 15')} END AS source_record_id FROM {{events}}")
    found = N.with_family(rows, _rows(spark, sf_dir, _SOURCES.format(events="{events}")))
    return found.groupBy("family", "source_jurisdiction").agg(F.count(F.lit(1)).alias("n"))


_MIRROR = f"SELECT event_id AS ord, ' src-' || {_s('event_id % 4001')} AS id, 'mirror ' || {_s('event_id')} AS title, CASE WHEN event_id % 2 = 0 THEN 'EU' END AS jurisdiction, 'old' AS citation FROM {{events}} WHERE event_id % 5 < 2"
_PRIMARY = f"SELECT event_id AS ord, 'src-' || {_s('event_id % 4001')} AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'primary ' || {_s('event_id')} END AS title, CASE WHEN event_id % 3 = 0 THEN 'UK' END AS jurisdiction FROM {{events}} WHERE event_id % 5 IN (1, 2)"
_LISTED = f"SELECT event_id AS ord, CASE WHEN event_id % 4001 = 0 THEN ' ' ELSE 'src-' || {_s('event_id % 4001')} END AS id, 'listed ' || {_s('event_id')} AS title, 'IE' AS jurisdiction, 'inv' AS citation FROM {{events}} WHERE event_id % 5 IN (2, 3)"


def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a mirror, a primary relation laid over it, and an inventory that fills gaps."""
    return N.merged_sources(*(_rows(spark, sf_dir, q.format(events="{events}")) for q in (_MIRROR, _PRIMARY, _LISTED)), ["title", "jurisdiction", "citation"])


_FIND_SQL = f"""
WITH ass AS ({_ASSESS_DUCK}), so AS ({_SOURCES.format(**_EVENTS)}), fr AS ({_FRAGMENTS.format(**_EVENTS)}), pr AS ({_PROPS.format(**_EVENTS)}),
last AS (SELECT source_record_id, arg_max(id, ord) AS f FROM fr GROUP BY 1), own AS (SELECT pr.id, coalesce(CASE WHEN trim(source_fragment_id) <> '' THEN source_fragment_id END, f) AS f FROM pr LEFT JOIN last USING (source_record_id)),
chk AS (SELECT ord, s, p FROM (SELECT ord, unnest(sources_checked) AS s, generate_subscripts(sources_checked, 1) AS p FROM ass)),
g AS (SELECT c.ord, list(current_snapshot_id ORDER BY p) FILTER (current_snapshot_id <> '') AS snaps, max(as_of_date) AS as_of_date, list(f ORDER BY p) FILTER (f IS NOT NULL) AS fs FROM chk c LEFT JOIN so ON so.id = c.s LEFT JOIN last ON last.source_record_id = c.s GROUP BY 1),
o AS (SELECT ass.ord, ass.id, coalesce(CASE WHEN trim(finding_id) <> '' THEN finding_id END, 'finding-' || proposition_id || '-' || comparator_proposition_id) AS finding_id, proposition_id, comparator_proposition_id, jurisdiction_a, jurisdiction_b, coalesce(snaps, []) AS source_snapshot_ids, as_of_date, a.f AS primary_fragment, b.f AS comparator_fragment,
  list_filter(coalesce(fs, []), lambda x: x IS DISTINCT FROM a.f AND x IS DISTINCT FROM b.f) AS supporting_fragments FROM ass LEFT JOIN own a ON a.id = proposition_id LEFT JOIN own b ON b.id = comparator_proposition_id LEFT JOIN g ON g.ord = ass.ord),
obs AS (SELECT *, list_filter([CASE WHEN primary_fragment IS NULL THEN '{N.LIMITS[0]}' END, CASE WHEN comparator_fragment IS NULL THEN '{N.LIMITS[1]}' END, CASE WHEN len(supporting_fragments) = 0 THEN '{N.LIMITS[2]}' END], lambda x: x IS NOT NULL) AS limitations FROM o)"""
_SLUG = "trim(regexp_replace(lower(id), '[^a-z0-9]+', '-', 'g'), '-')"
_FETCH_SQL = f"""fe AS (SELECT 'fetch-' || {_SLUG} AS fetch_id, id AS source_record_id, authority, nullif(authority_source_id, '') AS source_identifier, nullif(citation, '') AS citation, source_url, retrieved_at, coalesce(nullif(so.content_hash, ''), tr.content_hash) AS content_hash,
  coalesce(fetch_status, nullif(decision, ''), 'unknown') AS fetch_status, 'bundle://source_records/' || id AS parsed_artifact_uri, nullif(cache_key, '') AS cache_key, version_id FROM ({_SOURCES.format(**_EVENTS)}) so JOIN ({_TRACES.format(**_EVENTS)}) tr ON tr.source_record_id = so.id)"""
_INVENTORY_SQL = f"""
WITH {_FETCH_SQL}, so AS ({_SOURCES.format(**_EVENTS)}), t AS (SELECT id, nullif(citation, '') AS c, coalesce(nullif(instrument_id, ''), nullif(citation, ''), id) AS i FROM so ORDER BY NOT is_target_source, ord LIMIT 1)
SELECT 'source-inventory-' || {_SLUG.replace("id", "so.id")} AS row_id, so.id AS source_record_id, jurisdiction, coalesce(nullif(instrument_id, ''), nullif(so.citation, ''), so.id) AS instrument_id, title, kind AS instrument_type, status, nullif(so.citation, '') AS citation, fetch_id, fetch_status, t.id AS primary_target_id, t.c AS primary_target_citation, t.i AS primary_target_instrument, so.id = t.id AS is_primary_target
FROM so LEFT JOIN fe ON fe.source_record_id = so.id, t"""
_FAMILY_SQL = f"""
WITH so AS ({_SOURCES.format(**_EVENTS)}), p AS (SELECT CASE WHEN event_id % 10 < 2 THEN '' ELSE 'src-' || (user_id % 15)::VARCHAR END AS s FROM events)
SELECT CASE WHEN s = '' THEN '__no_source__' WHEN so.id IS NULL THEN '__orphan__:' || s ELSE coalesce(nullif(instrument_id, ''), nullif(family_token, ''), '__source:' || so.id) END AS family, CASE WHEN so.id IS NULL OR jurisdiction = '' THEN '—' ELSE jurisdiction END AS source_jurisdiction, count(*) AS n FROM p LEFT JOIN so ON so.id = s GROUP BY 1, 2"""
_MERGED_SQL = f"""
WITH m AS (SELECT trim(id) AS id, arg_min({{'t': title, 'j': jurisdiction, 'c': citation}}, ord) AS s FROM ({_MIRROR.format(**_EVENTS)}) GROUP BY 1), p AS (SELECT id, arg_max({{'t': title, 'j': jurisdiction}}, ord) AS s FROM ({_PRIMARY.format(**_EVENTS)}) GROUP BY 1),
i AS (SELECT id, arg_min({{'t': title, 'j': jurisdiction, 'c': citation}}, ord) AS s FROM ({_LISTED.format(**_EVENTS)}) WHERE trim(id) <> '' GROUP BY 1), ids AS (SELECT id FROM m UNION SELECT id FROM p UNION SELECT id FROM i)
SELECT ids.id, CASE WHEN p.id IS NOT NULL THEN p.s.t WHEN m.id IS NOT NULL THEN m.s.t ELSE i.s.t END AS title, CASE WHEN p.id IS NOT NULL THEN p.s.j WHEN m.id IS NOT NULL THEN m.s.j ELSE i.s.j END AS jurisdiction, CASE WHEN m.id IS NOT NULL THEN m.s.c WHEN p.id IS NOT NULL THEN NULL ELSE i.s.c END AS citation, m.id IS NULL AND p.id IS NULL AS summary_only
FROM ids LEFT JOIN m ON m.id = ids.id LEFT JOIN p ON p.id = ids.id LEFT JOIN i ON i.id = ids.id"""

# --- traces and roll-ups ---------------------------------------------------------------------------------------------
_META = """CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 23 = 1 THEN 'no json' ELSE '{{"extraction_mode":"' || CASE WHEN event_id % 5 = 1 THEN 'heuristic' ELSE 'frontier' END || '","fallback_used":' || CASE WHEN event_id % 7 = 2 THEN 'true' ELSE 'false' END || ',"validation_errors":' || CASE WHEN event_id % 6 = 3 THEN '["bad field"," ","late"]' ELSE '[]' END ||
 ',"model_confidence":"' || CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'High' WHEN 1 THEN 'low' ELSE 'sure' END || '","trace_warnings":' || CASE WHEN event_id % 11 = 5 THEN '["warned"]' ELSE '[]' END || ',"evidence_quote":"' || CASE WHEN event_id % 9 = 7 THEN '' ELSE 'quote ' || CAST(event_id % 10 AS STRING) END || '"}}' END"""
_NOTED = f"""SELECT 'prop-' || {_s("event_id")} AS id, 'run-' || {_s("event_id % 8")} AS run_id, 'src-' || {_s("user_id % 13")} AS source_record_id, CASE WHEN event_id % 37 = 0 THEN ' ' ELSE event_type END AS proposition_text, CASE WHEN event_id % 3 = 0 THEN ' heuristic extraction ' ELSE 'other' END AS notes, {_META} AS meta,
 CASE WHEN event_id % 10 = 3 THEN 'needs_review' ELSE 'proposed' END AS review_status, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'article:' || {_s("event_id % 20")} END AS fragment_locator, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'Article 1' END AS article_reference FROM {{events}}"""
_CALLS = f"""SELECT 'run-' || {_s("event_id % 8")} AS run_id, event_id AS ord, event_id % 3 = 0 AS llm_invoked, event_id % 3 = 1 AS skipped_llm, CASE WHEN event_id % 9 = 1 THEN 'context_window_risk' WHEN event_id % 9 = 4 THEN 'other' END AS skip_reason, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id % 50 - 3 END AS estimated_input_tokens,
 CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'article:' || {_s("event_id")} END AS fragment_locator, 'src-' || {_s("user_id")} AS source_record_id FROM {{events}}"""
_MESSAGES = f"""SELECT CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'Proposition missing extraction trace: prop-' || {_s("event_id")} WHEN 1 THEN 'source fragment without hash (' || event_type || '): frag ' || {_s("user_id")} || ' (id-' || {_s("user_id")} || ')' WHEN 2 THEN 'no colon here' WHEN 3 THEN 'see: http://law/' || {_s("event_id")} WHEN 4 THEN 'successful fetch without hash:'
 WHEN 5 THEN 'Duplicate content_hash: two words' WHEN 6 THEN 'proposition x lacks text: ' || repeat('long ', 30) WHEN 7 THEN 'invalid scope_id: a: b-' || {_s("user_id")} ELSE 'parse trace: ' || event_type END AS message, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN ' Source parsing of x' WHEN 1 THEN 'Lint / quality summary' WHEN 2 THEN 'Other' WHEN 3 THEN 'Scope linking' WHEN 4 THEN 'Export bundle done' ELSE 'source intake' END AS title FROM {{events}}"""
_LINKED = f"""SELECT 'prop-' || {_s("event_id % 997")} AS id, CASE WHEN event_id % 3 = 0 THEN 'animal' ELSE 'equine' END AS scope_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN ' Direct' WHEN 1 THEN 'contextual' WHEN 2 THEN 'none' WHEN 3 THEN 'direct' WHEN 4 THEN NULL ELSE 'indirect' END AS relevance FROM {{events}} WHERE event_id % 7 < 3"""


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _NOTED)


def extraction_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace of each proposition from its notes."""
    return R.extraction_traces(_noted(spark, sf_dir), True)


def extraction_trace_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over all traces."""
    return R.trace_metrics(extraction_traces(spark, sf_dir))


def call_trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls of each run, and its largest."""
    return R.call_summary(_rows(spark, sf_dir, _CALLS), ["run_id"])


#: Events whose calls share a row of a stage trace: 4,096 calls of each of the eight runs.
PART_EVENTS = 32_768


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage traces of the runs with their calls nested in JSON, in parts of bounded size."""
    calls = _rows(spark, sf_dir, _CALLS).withColumn("part", F.floor(F.col("ord") / PART_EVENTS))
    fields = F.struct("ord", "llm_invoked", "skipped_llm", "skip_reason", "estimated_input_tokens", "fragment_locator", "source_record_id")
    nested = calls.groupBy("run_id", "part").agg(F.to_json(F.struct(F.when(F.col("run_id") != "run-3", "frontier").alias("extraction_mode"), F.sort_array(F.collect_list(fields)).alias("extraction_llm_call_traces"))).alias("inputs"))
    first = nested.select("run_id", F.lit(1).alias("position"), "part", F.lit("proposition extraction").alias("stage_name"), "inputs")
    return first.unionByName(first.withColumns({"position": F.lit(2), "inputs": F.lit("{}")})).unionByName(first.withColumns({"position": F.lit(0), "stage_name": F.lit("other")}))


def job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each run from its stage traces, traces and propositions."""
    props = _noted(spark, sf_dir)
    runs = props.select("run_id").distinct().select("run_id", F.when(F.col("run_id") == "run-1", "FAIL").when(F.col("run_id") == "run-2", "pass_with_warnings").otherwise("pass").alias("status"), F.when(F.col("run_id") == "run-4", 77).otherwise(0).alias("source_count"), F.lit(None).cast("long").alias("proposition_count"), F.lit(3).alias("warning_count"), F.lit(0).alias("llm_extraction_call_count"))
    traces = R.extraction_traces(props, True, carry=["run_id"])
    return R.job_metrics(runs, R.calls_of_stages(_stages(spark, sf_dir)), traces, props)


def message_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their gate and the id they name, and the stage of a title."""
    rows = _rows(spark, sf_dir, _MESSAGES)
    return rows.select("message", R.gate_of(F.col("message")).alias("gate"), R.affected_id(F.col("message")).alias("affected_id"), R.stage_of(F.col("title")).alias("stage"))


def warnings_by_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings counted by their prefix."""
    return R.warnings_by_gate(_rows(spark, sf_dir, _MESSAGES))


def scope_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest relevance of one scope for each proposition with links."""
    return R.strongest_relevance(_rows(spark, sf_dir, _LINKED), "equine")


_TRACES_SQL = f"""
noted AS ({_NOTED.format(**_EVENTS)}), m AS (SELECT *, CASE WHEN meta LIKE '{{%' THEN meta::JSON END AS j FROM noted),
a AS (SELECT *, j IS NOT NULL AS has, j->>'$.extraction_mode' AS mode, coalesce((j->>'$.fallback_used')::BOOLEAN, false) AS fell, lower(j->>'$.model_confidence') AS sure, j->>'$.evidence_quote' AS quote, coalesce(from_json(j->'$.validation_errors', '["VARCHAR"]'), []) AS ve0, coalesce(from_json(j->'$.trace_warnings', '["VARCHAR"]'), []) AS tw FROM m),
b AS (SELECT *, list_filter(ve0, lambda x: trim(x) <> '') AS ve, CASE WHEN has AND mode = 'heuristic' THEN 'heuristic' WHEN has AND fell THEN 'fallback' WHEN has THEN 'llm' WHEN trim(notes) = 'heuristic extraction' THEN 'fallback' ELSE 'llm' END AS method FROM a),
traces AS (SELECT 'trace:' || left(sha256(id), 16) AS trace_id, id, run_id, method, CASE method WHEN 'fallback' THEN 'extract.heuristic_fallback' WHEN 'heuristic' THEN 'extract.heuristic' ELSE CASE WHEN has THEN 'extract.model_json_v2' ELSE 'extract.llm_json' END END AS extractor,
  CASE WHEN method <> 'heuristic' THEN 'extract.propositions.default' END AS prompt_id, CASE WHEN method <> 'heuristic' THEN 'v2' END AS prompt_version, CASE WHEN method <> 'llm' THEN 'extract.heuristic.normative_sentences' END AS rule_id, 'v1' AS rule_version,
  CASE WHEN has AND (fell OR review_status = 'needs_review') THEN 'low' WHEN has AND method = 'llm' THEN CASE WHEN sure IN ('high', 'low') THEN sure ELSE 'medium' END WHEN method = 'fallback' THEN 'low' ELSE 'medium' END AS confidence,
  CASE WHEN has AND len(ve) > 0 THEN array_to_string(ve, '; ') WHEN has THEN CASE method {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.REASONS["traced"].items())} END ELSE CASE method {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.REASONS["classified"].items())} END END AS reason,
  CASE WHEN has AND method = 'llm' AND trim(quote) = '' THEN list_append(tw, '{R.NO_QUOTE}') WHEN NOT has AND method = 'fallback' THEN ['{R.FELL_BACK}'] ELSE tw END AS warnings, CASE WHEN trim(proposition_text) = '' THEN ['empty proposition_text'] ELSE [] END AS errors, ve AS validation_errors,
  CASE WHEN trim(proposition_text) = '' THEN 'failed' WHEN len(ve) > 0 THEN 'partial_success' ELSE 'success' END AS status, CASE WHEN has THEN quote ELSE proposition_text END AS evidence_text, coalesce(nullif(fragment_locator, ''), nullif(article_reference, '')) AS evidence_locator, CASE WHEN has THEN fell END AS fallback_used FROM b)"""
_COUNTS = "count(*) FILTER (llm_invoked) AS llm_extraction_call_count, count(*) FILTER (skipped_llm) AS llm_extraction_skipped_count, count(*) FILTER (skip_reason = 'context_window_risk') AS context_window_risk_count, coalesce(sum(estimated_input_tokens) FILTER (estimated_input_tokens > 0), 0)::BIGINT AS estimated_input_tokens"
_SUMMARY_SQL = f"sm AS (SELECT run_id, {_COUNTS}, max(estimated_input_tokens) FILTER (estimated_input_tokens > 0) AS max_estimated_input_tokens, (arg_min({{'x': nullif(trim(fragment_locator), '')}}, (-estimated_input_tokens, ord)) FILTER (estimated_input_tokens > 0)).x AS largest_fragment_locator, (arg_min({{'x': source_record_id}}, (-estimated_input_tokens, ord)) FILTER (estimated_input_tokens > 0)).x AS largest_source_record_id FROM ({_CALLS.format(**_EVENTS)}) GROUP BY 1)"
_METRICS_SQL = f"""WITH {_TRACES_SQL} SELECT count(*) AS traced_count, {", ".join(f"count(*) FILTER (method = '{k}') AS {k}_count" for k in ("heuristic", "llm", "manual", "imported", "fallback"))}, sum(len(warnings))::BIGINT AS warning_count, sum(len(errors))::BIGINT AS error_count, count(*) FILTER (fallback_used) AS fallback_used_count, count(*) FILTER (confidence = 'low') AS low_confidence_count FROM traces"""
_JOBS_SQL = f"""WITH {_TRACES_SQL},{_SUMMARY_SQL}, p AS (SELECT run_id, count(*) AS n, count(DISTINCT source_record_id) AS s FROM noted GROUP BY 1), t AS (SELECT run_id, count(*) FILTER (fallback_used) AS f, count(*) FILTER (confidence = 'low') AS l FROM traces GROUP BY 1)
SELECT p.run_id, CASE WHEN p.run_id = 'run-3' THEN 'unknown' ELSE 'frontier' END AS extraction_mode, CASE WHEN p.run_id = 'run-4' THEN 77 ELSE s END AS source_count, n AS proposition_count, coalesce(llm_extraction_call_count, 0) AS llm_extraction_call_count, coalesce(llm_extraction_skipped_count, 0) AS llm_extraction_skipped_count, coalesce(context_window_risk_count, 0) AS context_window_risk_count,
 max_estimated_input_tokens, largest_fragment_locator, f AS fallback_count, l AS low_confidence_count, 3::BIGINT AS warning_count, CASE p.run_id WHEN 'run-1' THEN 'fail' WHEN 'run-2' THEN 'warning' ELSE 'pass' END AS job_status FROM p LEFT JOIN sm USING (run_id) LEFT JOIN t USING (run_id)"""
_GATES_SQL = rf"""
WITH ms AS ({_MESSAGES.format(**_EVENTS)}), x AS (SELECT *, trim(split_part(message, ':', -1)) AS tail FROM ms), y AS (SELECT *, coalesce(nullif(trim(regexp_extract(tail, '\(([^)]+)\)\s*$', 1)), ''), tail) AS inn FROM x)
SELECT message, CASE {" ".join(f"WHEN {' OR '.join(f'''contains(lower(message), '{n}')''' for n in needles)} THEN '{g}'" for g, needles in R.GATES)} ELSE 'general' END AS gate, CASE WHEN NOT contains(message, ':') OR tail = '' OR starts_with(tail, 'http') THEN NULL WHEN regexp_matches(inn, '^[\w\-]+$') THEN inn WHEN length(tail) <= 120 THEN tail END AS affected_id,
 CASE {" ".join(f"WHEN starts_with(trim(title), '{p}') THEN '{g}'" for p, g in R.STAGES)} END AS stage FROM y"""
_RELEVANCE_SQL = f"""SELECT id, ['unknown', 'none', 'contextual', 'indirect', 'direct'][max(CASE WHEN scope_id = 'equine' THEN coalesce(list_position(['unknown', 'none', 'contextual', 'indirect', 'direct'], lower(trim(relevance))), 1) ELSE 1 END)] AS relevance FROM ({_LINKED.format(**_EVENTS)}) GROUP BY 1"""

QUERIES = {
    "divergence_findings": (divergence_findings, f"{_FIND_SQL} SELECT finding_id, arg_min(proposition_id, ord) AS proposition_id, arg_min(comparator_proposition_id, ord) AS comparator_proposition_id, arg_min(jurisdiction_a, ord) AS jurisdiction_a, arg_min(jurisdiction_b, ord) AS jurisdiction_b, count(*) AS observations FROM obs GROUP BY 1"),
    "divergence_observations": (divergence_observations, f"{_FIND_SQL} SELECT * FROM obs"),
    "source_fetch_metadata": (source_fetch_metadata, f"WITH {_FETCH_SQL} SELECT * FROM fe"),
    "source_inventory": (source_inventory, _INVENTORY_SQL),
    "source_families": (source_families, _FAMILY_SQL),
    "merged_sources": (merged_sources, _MERGED_SQL),
    "extraction_traces": (extraction_traces, f"WITH {_TRACES_SQL} SELECT * EXCLUDE (run_id) FROM traces"),
    "extraction_trace_metrics": (extraction_trace_metrics, _METRICS_SQL),
    "call_trace_summary": (call_trace_summary, f"WITH {_SUMMARY_SQL} SELECT * FROM sm"),
    "job_metrics": (job_metrics, _JOBS_SQL),
    "message_gates": (message_gates, _GATES_SQL),
    "warnings_by_gate": (warnings_by_gate, f"SELECT CASE WHEN contains(message, ':') THEN trim(split_part(message, ':', 1)) ELSE 'general' END AS gate, count(*) AS n FROM ({_MESSAGES.format(**_EVENTS)}) GROUP BY 1"),
    "scope_relevance": (scope_relevance, _RELEVANCE_SQL),
}

"""All integrity rules over a run whose tables break each of them, with DuckDB SQL that states the rules once more.

Every table is made of events: a fault stands in the rows whose id leaves a certain rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lint as Q


def _when(divisor: int, rest: int, fault: str, else_: str, of: str = "event_id") -> str:
    return f"CASE WHEN {of} % {divisor} = {rest} THEN {fault} ELSE {else_} END"


def _id(prefix: str, number: str = "event_id") -> str:
    return f"'{prefix}-' || CAST({number} AS STRING)"


#: The tables; {none} and {some} are an empty and a filled array.
_TABLES = {
    "run_artifacts": f"SELECT {_id('ra')} AS id, {_when(41, 3, 'NULL', _id('h'))} AS content_hash FROM {{events}}",
    "sources": f"SELECT {_id('src', 'event_id % 500')} AS id, {_when(7, 2, chr(39) + 'same' + chr(39), _id('hash', 'event_id % 500'), 'event_id % 500')} AS content_hash, {_id('cite', 'event_id % 500 % 90')} AS citation, {_when(7, 2, _id('snap', 'event_id % 3'), _id('snap', 'event_id % 500'), 'event_id % 500')} AS current_snapshot_id, {_when(5, 1, 'NULL', _id('http', 'event_id % 500'), 'event_id % 500')} AS source_url FROM {{events}} WHERE event_id < 500",
    "snapshots": f"SELECT {_id('snap', 'event_id % 700')} AS id, {_when(31, 4, chr(39) * 2, chr(39) + 'xml' + chr(39))} AS parser_name, {_when(37, 5, 'NULL', chr(39) + '1' + chr(39))} AS parser_version FROM {{events}} WHERE event_id < 700",
    "fragments": f"SELECT {_when(101, 1, _id('frag', 'event_id - 1'), _id('frag'))} AS id, {_when(43, 1, 'NULL', _id('src', 'event_id % 505'))} AS source_record_id, {_when(47, 2, chr(39) + ' ' + chr(39), _id('snap', 'event_id % 703'))} AS source_snapshot_id, {_when(53, 3, chr(39) * 2, _id('t'))} AS text_hash, CASE CAST(event_id % 59 AS INT) WHEN 1 THEN 'page' WHEN 2 THEN 'unknown' ELSE 'article' END AS fragment_type, {_when(61, 4, 'NULL', _id('loc'))} AS locator FROM {{events}}",
    "propositions": f"SELECT {_id('prop')} AS id, {_when(67, 5, 'NULL', _id('src', 'event_id % 502'))} AS source_record_id, {_when(71, 6, chr(39) * 2, _id('snap', 'event_id % 703'))} AS source_snapshot_id, CASE CAST(event_id % 73 AS INT) WHEN 1 THEN NULL WHEN 2 THEN 'frag-gone' WHEN 3 THEN {_id('frag', '(event_id + 1) % 5000')} ELSE {_id('frag')} END AS source_fragment_id, {_when(79, 7, '{{odd}}', '{{good}}')} AS categories, {_when(83, 8, chr(39) + ' ' + chr(39), chr(39) + 'text' + chr(39))} AS proposition_text FROM {{events}}",
    "traces": f"SELECT {_when(103, 1, _id('trace', 'event_id - 1'), _id('trace'))} AS id, {_when(89, 9, chr(39) + 'prop-gone' + chr(39), _id('prop'))} AS proposition_id, CASE CAST(event_id % 29 AS INT) WHEN 1 THEN 'fallback' WHEN 2 THEN 'guessed' ELSE 'llm' END AS extraction_method, {_when(2, 1, chr(39) * 2, chr(39) + 'why' + chr(39))} AS reason, {_when(23, 2, chr(39) + 'low' + chr(39), chr(39) + 'high' + chr(39))} AS confidence, {_when(97, 10, 'NULL', chr(39) + 'said' + chr(39))} AS evidence_text, {_when(97, 11, chr(39) * 2, chr(39) + 'there' + chr(39))} AS evidence_locator, {_id('src', 'event_id % 503')} AS source_record_id, {_id('snap', 'event_id % 703')} AS source_snapshot_id, CASE CAST(event_id % 73 AS INT) WHEN 4 THEN 'frag-none' WHEN 5 THEN {_id('frag', '(event_id + 2) % 5000')} ELSE {_id('frag')} END AS source_fragment_id FROM {{events}}",
    "inventory": f"SELECT {_id('inv')} AS id, {_when(31, 1, 'NULL', _id('h'))} AS content_hash, {_when(37, 2, chr(39) * 2, _id('src', 'event_id'))} AS source_record_id, CASE CAST(event_id % 11 AS INT) WHEN 1 THEN 'odd_role' WHEN 2 THEN 'unknown' WHEN 3 THEN 'annex' ELSE 'guidance' END AS source_role, CASE CAST(event_id % 13 AS INT) WHEN 1 THEN 'odd' WHEN 2 THEN 'unknown' ELSE 'contextual_source' END AS relationship_to_analysis, {_when(17, 3, 'NULL', chr(39) + 'http' + chr(39))} AS source_url, {_when(19, 4, 'NULL', chr(39) + 'v1' + chr(39))} AS version_id, {_when(2, 0, 'NULL', chr(39) + '2026-01-01' + chr(39))} AS consolidation_date FROM {{events}}",
    "fetch_metadata": f"SELECT {_id('src', 'event_id % 480')} AS source_record_id FROM {{events}}",
    "fetch_attempts": f"SELECT {_id('src', 'event_id % 470')} AS source_record_id, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'success' WHEN 1 THEN 'cache_hit' ELSE 'failed' END AS status, {_when(43, 5, 'NULL', _id('h'))} AS content_hash, {_when(47, 6, chr(39) * 2, _id('raw'))} AS raw_artifact_uri FROM {{events}}",
    "parse_traces": f"SELECT {_id('snap', 'event_id % 690')} AS source_snapshot_id, {_when(53, 7, chr(39) + 'failed' + chr(39), chr(39) + 'done' + chr(39))} AS status FROM {{events}}",
    "rationales": f"SELECT {_id('src', 'event_id')} AS source_record_id, CASE CAST(event_id % 17 AS INT) WHEN 1 THEN 'fallback' WHEN 2 THEN 'dice' ELSE 'manual' END AS method, CASE CAST(event_id % 19 AS INT) WHEN 1 THEN 'low' WHEN 2 THEN 'sure' ELSE 'high' END AS confidence, {_when(2, 1, 'NULL', chr(39) + 'why' + chr(39))} AS reason, {_when(3, 1, '{{none}}', '{{some}}')} AS evidence FROM {{events}} WHERE event_id % 61 <> 8",
    "links": f"SELECT {_id('link')} AS id, {_id('src', 'event_id')} AS source_record_id, CASE CAST(event_id % 13 AS INT) WHEN 1 THEN 'unknown' WHEN 2 THEN 'likes' ELSE 'amends' END AS link_type, CASE CAST(event_id % 17 AS INT) WHEN 1 THEN 'low' WHEN 2 THEN 'sure' ELSE 'high' END AS confidence, {_when(2, 1, chr(39) + ' ' + chr(39), chr(39) + 'why' + chr(39))} AS reason, {_when(3, 1, 'NULL', '{{some}}')} AS evidence FROM {{events}} WHERE event_id % 67 <> 9",
    "decisions": f"""SELECT {_id('dec')} AS id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'proposition' WHEN 1 THEN 'source_target_link' WHEN 2 THEN 'proposition_extraction_trace' ELSE 'poem' END AS artifact_type, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN {_id('prop', 'event_id * 2')} WHEN 1 THEN {_id('link')} WHEN 2 THEN {_id('trace')} ELSE {_id('src', 'event_id')} END AS artifact_id,
 CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'rejected' WHEN 1 THEN 'overridden' WHEN 2 THEN 'approved' ELSE 'deferred' END AS decision, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '{{{{"reason": 5}}}}' ELSE '{{{{"reason": "so"}}}}' END AS replacement FROM {{events}}""",
    "artefacts": f"SELECT 'proposition' AS artifact_type, {_id('prop')} AS artifact_id FROM {{events}} UNION ALL SELECT 'source_target_link', {_id('link')} FROM {{events}} WHERE event_id % 67 <> 9 UNION ALL SELECT 'proposition_extraction_trace', {_id('trace')} FROM {{events}}",
    "observations": f"SELECT {_id('obs')} AS id, {_when(3, 0, chr(39) + 'none' + chr(39), chr(39) + 'structural' + chr(39))} AS divergence_type, {_when(31, 1, 'NULL', _id('frag'))} AS primary_source_fragment_id, {_when(37, 2, chr(39) * 2, _id('frag'))} AS comparator_source_fragment_id FROM {{events}}",
    "assessments": f"SELECT {_id('prop')} AS proposition_id, CASE CAST(event_id % 7 AS INT) WHEN 1 THEN 'fragmentary' WHEN 2 THEN 'context_dependent' ELSE 'complete' END AS status, {_when(2, 0, chr(39) * 2, chr(39) + 'better' + chr(39))} AS suggested FROM {{events}}",
    "scopes": f"SELECT {_id('scope', 'event_id % 50')} AS id, {_when(9, 1, chr(39) + 'deprecated' + chr(39), chr(39) + 'active' + chr(39))} AS status FROM {{events}} WHERE event_id < 50",
    "scope_links": f"SELECT {_id('sl')} AS id, {_when(41, 1, chr(39) + 'prop-gone' + chr(39), _id('prop'))} AS proposition_id, {_id('scope', 'event_id % 51')} AS scope_id, CASE CAST(event_id % 11 AS INT) WHEN 1 THEN 'fallback' WHEN 2 THEN 'dice' ELSE 'deterministic' END AS method, CASE CAST(event_id % 7 AS INT) WHEN 1 THEN 'contextual' WHEN 2 THEN 'vague' ELSE 'direct' END AS relevance, CASE CAST(event_id % 13 AS INT) WHEN 1 THEN 'odd' WHEN 2 THEN 'inherited' ELSE 'explicit' END AS inheritance, CASE CAST(event_id % 5 AS INT) WHEN 1 THEN 'low' WHEN 2 THEN 'sure' ELSE 'high' END AS confidence, {_when(2, 1, chr(39) * 2, chr(39) + 'why' + chr(39))} AS reason, {_when(3, 1, '{{none}}', '{{some}}')} AS evidence, CASE CAST(event_id % 17 AS INT) WHEN 1 THEN NULL WHEN 2 THEN 'source_title' ELSE 'conditions' END AS evidence_field FROM {{events}}",
    "scope_candidates": f"SELECT {_id('prop')} AS proposition_id, {_id('scope', 'event_id % 51')} AS scope_id FROM {{events}} WHERE event_id % 3 = 0",
}
_SPARK = {"none": "CAST(array() AS array<string>)", "some": "array('x')", "odd": "array('obligation', 'poetry')", "good": "array('oversight')"}
_DUCK = {"none": "[]::VARCHAR[]", "some": "['x']", "odd": "['obligation', 'poetry']", "good": "['oversight']"}


def _filled(query: str, arrays: dict[str, str], events: str) -> str:
    """The table's SQL for one of the two engines; doubled braces are those of the engine's own formatting."""
    return query.replace("{events}", events).replace("{{none}}", arrays["none"]).replace("{{some}}", arrays["some"]).replace("{{odd}}", arrays["odd"]).replace("{{good}}", arrays["good"]).replace("{none}", arrays["none"]).replace("{some}", arrays["some"]).replace("{odd}", arrays["odd"]).replace("{good}", arrays["good"])


def run_tables(spark: SparkSession, sf_dir: str) -> Q.Tables:
    """The tables of the run."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("provisio_rule_events")
    try:
        return {name: spark.sql(_filled(query, _SPARK, "provisio_rule_events").replace("{{", "{").replace("}}", "}")) for name, query in _TABLES.items()}
    finally:
        spark.catalog.dropTempView("provisio_rule_events")


def integrity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of all rules."""
    return Q.lint(run_tables(spark, sf_dir), Q.RUN_CHECKS)


def integrity_rules_of_empty_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules say where traces, inventory and scopes have no rows: counts by code."""
    tables = run_tables(spark, sf_dir)
    gone = {n: tables[n].filter("false") for n in ("traces", "inventory", "scopes")}
    found = Q.lint(tables | gone, [c for c in Q.RUN_CHECKS if c.code in ("L12", "L14", "L26", "L77", "L78", "L84")])
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


_BLANK = "coalesce(trim({0}::VARCHAR), '') = ''"
_UNREASONED = "coalesce(trim(reason), '') = ''"
_UNPROVEN = "coalesce(len(evidence), 0) <= 0"
#: Rules by code: the table with the condition that its rows break, or a whole query of ids.
_BLANKS = {
    "L4": ("run_artifacts", "content_hash"), "L5": ("propositions", "source_record_id"), "L7": ("propositions", "source_snapshot_id"), "L20": ("traces", "evidence_text"), "L21": ("traces", "evidence_locator"), "L30": ("fragments", "source_record_id"), "L32": ("fragments", "source_snapshot_id"), "L34": ("fragments", "text_hash"), "L37": ("fragments", "locator"),
    "L59": ("inventory", "content_hash"), "L60": ("inventory", "source_record_id"), "L69": ("inventory", "source_url"),
}
_ORPHANS = {
    "L6": ("propositions", "source_record_id", "sources", "id"), "L8": ("propositions", "source_snapshot_id", "snapshots", "id"), "L9": ("propositions", "source_fragment_id", "fragments", "id"), "L14": ("propositions", "id", "traces", "proposition_id"), "L15": ("traces", "proposition_id", "propositions", "id"), "L22": ("traces", "source_record_id", "sources", "id"),
    "L23": ("traces", "source_snapshot_id", "snapshots", "id"), "L24": ("traces", "source_fragment_id", "fragments", "id"), "L27": ("sources", "id", "fetch_metadata", "source_record_id"), "L31": ("fragments", "source_record_id", "sources", "id"), "L33": ("fragments", "source_snapshot_id", "snapshots", "id"), "L63": ("inventory", "source_record_id", "links", "source_record_id"),
    "L65": ("inventory", "source_record_id", "rationales", "source_record_id"), "L78": ("scope_links", "scope_id", "scopes", "id"), "L79": ("scope_links", "proposition_id", "propositions", "id"),
}
_WHERE = {
    "L16": ("traces", "extraction_method NOT IN ('heuristic', 'llm', 'manual', 'imported', 'fallback')"), "L17": ("traces", f"extraction_method = 'fallback' AND {_UNREASONED}"), "L18": ("traces", "confidence = 'low'"), "L19": ("traces", "confidence = 'low' AND id NOT IN (SELECT artifact_id FROM decisions)"),
    "L29": ("snapshots", "coalesce(parser_name, '') = '' OR coalesce(parser_version, '') = ''"), "L35": ("fragments", "fragment_type = 'page'"), "L36": ("fragments", "fragment_type = 'unknown'"), "L51": ("links@source_record_id", "link_type = 'likes'"), "L52": ("links@source_record_id", "confidence = 'sure'"), "L53": ("links@source_record_id", "link_type = 'unknown'"), "L54": ("links@source_record_id", "confidence = 'low'"),
    "L55": ("links", "confidence = 'low' AND id NOT IN (SELECT artifact_id FROM decisions)"), "L56": ("links@source_record_id", f"link_type = 'unknown' AND {_UNREASONED}"), "L57": ("links@source_record_id", f"link_type = 'unknown' AND {_UNPROVEN}"), "L41": ("fetch_attempts@source_record_id", "status IN ('success', 'cache_hit') AND coalesce(content_hash, '') = ''"), "L42": ("fetch_attempts@source_record_id", "status IN ('success', 'cache_hit') AND coalesce(raw_artifact_uri, '') = ''"),
    "L45": ("rationales@source_record_id", "method = 'dice'"), "L46": ("rationales@source_record_id", "confidence = 'sure'"), "L47": ("rationales@source_record_id", "confidence = 'low'"), "L48": ("rationales@source_record_id", "confidence = 'low' AND source_record_id NOT IN (SELECT artifact_id FROM decisions)"), "L49": ("rationales@source_record_id", f"method = 'fallback' AND {_UNREASONED}"), "L50": ("rationales@source_record_id", f"method = 'fallback' AND {_UNPROVEN}"),
    "L61": ("inventory", "source_role = 'odd_role'"), "L62": ("inventory", "relationship_to_analysis = 'odd'"), "L64": ("inventory", "source_record_id IN (SELECT source_record_id FROM links WHERE link_type = 'unknown')"), "L66": ("inventory", f"source_role = 'annex' AND source_record_id IN (SELECT source_record_id FROM links WHERE link_type = 'unknown' AND ({_UNREASONED} OR {_UNPROVEN}))"), "L67": ("inventory", "source_role = 'unknown'"), "L68": ("inventory", "relationship_to_analysis = 'unknown'"),
    "L70": ("inventory", "coalesce(version_id, '') = '' AND consolidation_date IS NULL"), "L71": ("observations", "divergence_type <> 'none' AND coalesce(primary_source_fragment_id, '') = ''"), "L72": ("observations", "divergence_type <> 'none' AND coalesce(comparator_source_fragment_id, '') = ''"), "L58": ("links", "id IN (SELECT artifact_id FROM decisions WHERE decision = 'rejected') AND source_record_id IN (SELECT source_record_id FROM inventory)"),
    "L73": ("traces", "id IN (SELECT artifact_id FROM decisions WHERE decision = 'rejected') AND proposition_id NOT IN (SELECT artifact_id FROM decisions WHERE decision IN ('approved', 'overridden'))"), "L74": ("assessments@proposition_id", "suggested <> '' AND proposition_id NOT IN (SELECT id FROM propositions WHERE trim(proposition_text) <> '')"), "L75": ("assessments@proposition_id", "status = 'fragmentary' AND proposition_id NOT IN (SELECT artifact_id FROM decisions)"), "L76": ("assessments@proposition_id", "status = 'context_dependent' AND suggested = ''"),
    "L80": ("scope_links", "method = 'dice'"), "L81": ("scope_links", "relevance = 'vague'"), "L82": ("scope_links", "inheritance = 'odd'"), "L83": ("scope_links", "confidence = 'sure'"), "L84": ("scope_links", "scope_id IN (SELECT id FROM scopes WHERE status = 'deprecated')"), "L85": ("scope_links", "confidence = 'low' AND relevance = 'direct'"), "L86": ("scope_links", f"method = 'fallback' AND {_UNREASONED}"), "L87": ("scope_links", f"method = 'fallback' AND {_UNPROVEN}"),
    "L88": ("scope_links", "method = 'deterministic' AND relevance = 'direct' AND coalesce(evidence_field, '') <> 'conditions'"), "L89": ("scope_links", "relevance = 'contextual' AND confidence = 'low' AND inheritance = 'explicit' AND (proposition_id, scope_id) NOT IN (SELECT proposition_id, scope_id FROM scope_candidates)"),
    "L40": ("parse_traces@source_snapshot_id", "status = 'failed' AND source_snapshot_id IN (SELECT source_snapshot_id FROM fragments)"),
}
_WHOLE = {
    "L1": "SELECT id FROM decisions WHERE decision = 'overridden' AND replacement IS NOT NULL AND artifact_type = 'poem'",
    "L2": "SELECT id FROM decisions d WHERE decision = 'overridden' AND replacement IS NOT NULL AND artifact_type <> 'poem' AND NOT EXISTS (SELECT 1 FROM artefacts a WHERE a.artifact_type = d.artifact_type AND a.artifact_id = d.artifact_id)",
    "L3": "SELECT id FROM decisions d WHERE decision = 'overridden' AND replacement LIKE '%5%' AND artifact_type IN ('source_target_link', 'proposition_extraction_trace') AND EXISTS (SELECT 1 FROM artefacts a WHERE a.artifact_type = d.artifact_type AND a.artifact_id = d.artifact_id)",
    "L10": "SELECT p.id FROM propositions p JOIN fragments f ON p.source_fragment_id = f.id WHERE p.source_snapshot_id IS DISTINCT FROM f.source_snapshot_id",
    "L25": "SELECT p.id FROM traces p JOIN fragments f ON p.source_fragment_id = f.id WHERE p.source_snapshot_id IS DISTINCT FROM f.source_snapshot_id",
    "L11": "SELECT id FROM (SELECT id, unnest(categories) AS c FROM propositions) WHERE c = 'poetry'",
    "L13": "SELECT id FROM traces GROUP BY id HAVING count(*) > 1", "L38": "SELECT id FROM fragments GROUP BY id HAVING count(*) > 1",
    "L28": "SELECT id FROM sources WHERE source_url <> '' AND id NOT IN (SELECT source_record_id FROM fetch_attempts)",
    "L39": "SELECT DISTINCT source_snapshot_id FROM fragments WHERE trim(source_snapshot_id) <> '' AND source_snapshot_id NOT IN (SELECT source_snapshot_id FROM parse_traces)",
    "L43": "SELECT content_hash FROM sources WHERE content_hash <> '' GROUP BY 1 HAVING count(DISTINCT id) > 1 AND count(DISTINCT citation) > 1",
    "L44": "SELECT current_snapshot_id FROM sources WHERE content_hash <> '' GROUP BY content_hash, current_snapshot_id HAVING count(DISTINCT id) > 1",
}


def _rules_sql() -> str:
    parts = [f"SELECT '{c}' AS code, id::VARCHAR AS id FROM {t} WHERE {_BLANK.format(col)}" for c, (t, col) in _BLANKS.items()]
    parts += [f"SELECT '{c}', id::VARCHAR FROM {t} x WHERE NOT {_BLANK.format(col)} AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{k} = x.{col})" for c, (t, col, p, k) in _ORPHANS.items()]
    parts += [f"SELECT '{c}', {(t.split('@') + ['id'])[1]}::VARCHAR FROM {t.split('@')[0]} WHERE {w}" for c, (t, w) in _WHERE.items()]
    parts += [f"SELECT '{c}', * FROM ({q})" for c, q in _WHOLE.items()]
    return " UNION ALL ".join(parts)


_TABLES_SQL = ", ".join(f"{n} AS MATERIALIZED ({_filled(q, _DUCK, 'events').replace('{{', '{').replace('}}', '}')})" for n, q in _TABLES.items())
_KNOWN = ", ".join(f"('{c.code}', '{c.severity}', '{c.gate}', '{c.message}')" for c in Q.RUN_CHECKS)
_RULES_SQL = f"WITH {_TABLES_SQL}, found AS ({_rules_sql()}), known AS (SELECT * FROM (VALUES {_KNOWN}) v(code, severity, gate, said)) SELECT code, severity, gate, id, said || ': ' || coalesce(id, 'unknown') AS message FROM found JOIN known USING (code)"
_EMPTY_SQL = f"WITH {_TABLES_SQL} SELECT 'L12' AS code, 'warning' AS severity, 1::BIGINT AS n UNION ALL SELECT 'L26', 'error', 1 UNION ALL SELECT 'L77', 'error', 1 UNION ALL SELECT 'L14', 'error', count(*) FROM propositions UNION ALL SELECT 'L78', 'error', count(*) FROM scope_links"

QUERIES = {
    "integrity_rules": (integrity_rules, _RULES_SQL),
    "integrity_rules_of_empty_tables": (integrity_rules_of_empty_tables, _EMPTY_SQL),
}

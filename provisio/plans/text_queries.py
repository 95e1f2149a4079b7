"""Queries over the fixture text: fields, identity, categories, completeness, divergence, locators; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import locators as L
from ..functions import text as T
from ..operators import extraction as X
from ..operators import propositions as P
from .fixture import LAW_SQL, law

RUN = "Run 2024-01"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- DuckDB forms of the text rules -------------------------------------------------------------------------------
def _squash(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _slug(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item')"


def _after(low: str, word: str) -> str:
    return f"trim(substr({low}, instr({low}, {_q(word)}) + {len(word)}), ' .,:;')"


def _cases(low: str, pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({low}, {_q(w)}) THEN {v}" for w, v in pairs) + f" ELSE {default} END"


def _listed(low: str, pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains({low}, {_q(w)}) THEN {v} END" for w, v in pairs) + "], lambda x: x IS NOT NULL)"


_FIRST = r"lower(regexp_extract(regexp_replace(proposition_text, '^(article|section|regulation|paragraph|schedule)\s+\d+[a-z]?[.:]?\s*', '', 'i'), '(\S+)', 1))"
FIELDS_SQL = f"""
low0 AS (SELECT *, lower(proposition_text) AS low FROM law),
fields AS (SELECT *,
  {_cases("low", [(w, _q(w)) for w in T.SUBJECTS], f"coalesce(nullif({_FIRST}, ''), 'actor')")} AS legal_subject,
  left({_cases("low", [(w, _squash(f"split_part({_after('low', w)}, '.', 1)")) for w in T.MODALS], _squash("proposition_text"))}, 120) AS action,
  {_listed("low", [(m, f"{_q(m.strip() + ' ')} || {_after('low', m)}") for m in T.CONDITIONS])}[1:3] AS conditions,
  {_cases("low", [(w, _q(v)) for w, v in T.AUTHORITIES], "NULL")} AS authority,
  {_listed("low", [(w, _q(w)) for w in T.DOCUMENTS])} AS required_documents,
  {" OR ".join(f"contains(low, {_q(w)})" for w in T.NORMATIVE)} AS normative,
  nullif(regexp_extract(proposition_text, '\\b((?:art(?:icle)?|section|regulation|paragraph|schedule)\\.?\\s*\\d+[a-z]?)\\b', 1, 'i'), '') AS text_reference
FROM low0)"""
CATEGORIES_SQL = f"""
cats AS (SELECT *,
  list_sort(list_filter(['obligation', CASE WHEN authority IS NOT NULL THEN 'institutional' END, CASE WHEN len(required_documents) > 0 THEN 'documentary' END, CASE WHEN len(conditions) > 0 THEN 'conditional' END,
    CASE WHEN contains(low, 'inspect') THEN 'oversight' END, CASE WHEN contains(low, 'record') OR contains(low, 'register') THEN 'record_keeping' END, CASE WHEN contains(low, 'submit') OR contains(low, 'return') THEN 'reporting' END], lambda x: x IS NOT NULL)) AS categories,
  list_sort(list_distinct(list_filter([CASE WHEN authority IS NOT NULL THEN {_slug("authority")} END, {_slug("legal_subject")}, {_slug("jurisdiction")}], lambda x: x IS NOT NULL))) AS tags
FROM fields)"""
_PLACEHOLDER = "lower(trim(coalesce({0}, ''))) IN ('', 'document:full', 'full', 'document')"
_SEGMENT = f"CASE WHEN NOT ({_PLACEHOLDER.format('raw')}) THEN {_slug('raw')} WHEN nullif(trim(source_fragment_id), '') IS NOT NULL THEN {_slug('source_fragment_id')} ELSE {_slug('source_record_id')} END"
IDENTITY_SQL = f"""
seqd AS (SELECT *, regexp_extract(id, '(\\d+)$', 1) AS seq, coalesce(nullif(fragment_locator, ''), nullif(article_reference, ''), source_fragment_id) AS raw,
         coalesce(nullif(trim(fragment_locator), ''), nullif(trim(article_reference), ''), source_fragment_id, '') AS anchor FROM cats),
keyed AS (SELECT *, {_slug('source_record_id')} || ':' || {_SEGMENT} || ':p' || CASE WHEN length(CAST(greatest(1, CAST(seq AS BIGINT)) AS VARCHAR)) < 3 THEN lpad(CAST(greatest(1, CAST(seq AS BIGINT)) AS VARCHAR), 3, '0') ELSE CAST(greatest(1, CAST(seq AS BIGINT)) AS VARCHAR) END AS proposition_key,
          concat_ws(':', {_slug('jurisdiction')}, {_slug('legal_subject')}, {_slug("left(CASE WHEN action = '' THEN proposition_text ELSE action END, 60)")}) AS cross_reference_key,
          concat_ws(' ', nullif(trim(legal_subject), ''), nullif(trim(action), '')) AS short_name FROM seqd)"""
BASE_SQL = f"WITH {LAW_SQL},{FIELDS_SQL},{CATEGORIES_SQL},{IDENTITY_SQL}\n"


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_identity(P.with_categories(P.with_fields(law(spark, sf_dir))), RUN)


# --- queries ------------------------------------------------------------------------------------------------------
def normative_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normative sentences of all fragments by jurisdiction and category: split, filter, fields, categories, counts."""
    cut = law(spark, sf_dir).withColumn("proposition_text", F.explode(T.sentences(F.col("proposition_text")))).filter(T.is_normative(F.col("proposition_text")))
    found = P.with_categories(P.with_fields(cut)).select("jurisdiction", "legal_subject", F.explode("categories").alias("category"))
    return found.groupBy("jurisdiction", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("legal_subject").alias("subjects"))


# RE2 has no look-around: the cut is marked first, then split.
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({_squash('proposition_text')}, '([.!?;])\s+(\(?[a-z0-9ivx]+\)|[A-Z])', '\1' || chr(1) || '\2', 'g'), '([.!?;])\s+(\(?[a-z0-9ivx]+\)|[A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda p: {_squash("trim(p, ' ;')")}), lambda p: p <> '')"
NORMATIVE_SQL = f"""
WITH law0 AS ({LAW_SQL[len("law AS ("):-1]}),
law AS (SELECT * EXCLUDE (proposition_text), unnest({_SENTENCES}) AS proposition_text FROM law0),{FIELDS_SQL},{CATEGORIES_SQL}
SELECT jurisdiction, category, count(*) AS n, count(DISTINCT legal_subject) AS subjects
FROM (SELECT jurisdiction, legal_subject, unnest(categories) AS category FROM cats WHERE normative) GROUP BY ALL
"""


def proposition_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, action, conditions, authority, documents and reference of every proposition."""
    rows = P.with_fields(law(spark, sf_dir))
    return rows.select("id", "legal_subject", "action", F.array_join("conditions", "|").alias("conditions"), "authority", F.array_join("required_documents", "|").alias("required_documents"), "normative", "text_reference", T.locator_reference(F.col("fragment_locator")).alias("locator_reference"))


PROPOSITION_FIELDS_SQL = f"""
WITH {LAW_SQL},{FIELDS_SQL}
SELECT id, legal_subject, action, array_to_string(conditions, '|') AS conditions, authority, array_to_string(required_documents, '|') AS required_documents, normative, text_reference,
  CASE WHEN NOT ({_PLACEHOLDER.format("fragment_locator")}) AND regexp_matches(fragment_locator, '(?i)(article|section|regulation|paragraph|schedule)[:/_-]?(\\d+[a-z]?)')
       THEN regexp_extract(fragment_locator, '(?i)(article|section|regulation|paragraph|schedule)[:/_-]?(\\d+[a-z]?)', 1) || ' ' || regexp_extract(fragment_locator, '(?i)(article|section|regulation|paragraph|schedule)[:/_-]?(\\d+[a-z]?)', 2) END AS locator_reference
FROM fields
"""


def proposition_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque ids, stable keys and version ids of every proposition."""
    return _props(spark, sf_dir).select("id", "machine_id", "proposition_key", "proposition_version_id", "cross_reference_key", "trace_id", "short_name")


PROPOSITION_IDENTITY_SQL = BASE_SQL + f"""
SELECT id, 'prop:' || left(sha256(source_record_id || chr(0) || anchor || chr(0) || seq), 16) AS machine_id, proposition_key,
  concat_ws(':', 'pver', proposition_key, {_slug('source_snapshot_id')}, {_slug(_q(RUN))}) AS proposition_version_id, cross_reference_key,
  'extract-trace:' || left(sha256('proposition_extraction_trace|' || id), 16) AS trace_id, short_name
FROM keyed
"""


def categories_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the inverted indexes over all propositions."""
    return P.inventory(_props(spark, sf_dir))


CATEGORIES_INVENTORY_SQL = BASE_SQL + """
SELECT kind, key, count(*) AS n FROM (
  SELECT 'jurisdiction' AS kind, jurisdiction AS key FROM keyed UNION ALL SELECT 'category', unnest(categories) FROM keyed UNION ALL SELECT 'tag', unnest(tags) FROM keyed
  UNION ALL SELECT 'cross_reference', cross_reference_key FROM keyed UNION ALL SELECT 'lineage', proposition_key FROM keyed) GROUP BY ALL
"""


def cross_reference_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other propositions share each one's cross-reference key."""
    return P.cross_references(_props(spark, sf_dir))


CROSS_REFERENCE_SQL = BASE_SQL + """
SELECT k.id, k.cross_reference_key, g.n - 1 AS targets, CASE WHEN k.id = g.ids[1] THEN g.ids[2] ELSE g.ids[1] END AS first_target
FROM keyed k JOIN (SELECT cross_reference_key, count(*) AS n, list(id ORDER BY id) AS ids FROM keyed GROUP BY 1) g USING (cross_reference_key)
"""


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standalone readability of every proposition; sources from `supplier`, parents where the locator is a list's."""
    rows = law(spark, sf_dir)
    sources = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("src-"), (F.col("s_suppkey") - 1).cast("string")).alias("source_record_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("").alias("citation"), F.concat(F.lit("Act of "), F.col("s_name")).alias("title"))
    parents = rows.filter("ord % 6 = 0").select("id", F.lit("The parent clause.").alias("parent_context"))
    found = P.completeness(rows, sources, parents)
    return found.withColumn("missing_context", F.array_join("missing_context", "|"))


_OP = P.OPERATIVE[4:]
COMPLETENESS_SQL = f"""
WITH {LAW_SQL},
src AS (SELECT 'src-' || (s_suppkey - 1) AS source_record_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Act of ' || s_name END AS instrument FROM supplier),
j AS (SELECT law.*, instrument, trim(proposition_text) AS t, lower(trim(proposition_text)) AS low, ord % 6 = 0 AS parent, regexp_matches(proposition_text, '(?i){_OP}') AS operative FROM law LEFT JOIN src USING (source_record_id)),
o AS (SELECT *, CASE {" ".join(f"WHEN starts_with(low, '{p}') THEN '{k}'" for p, k in P.OPENERS)} END AS opener FROM j),
r AS (SELECT *, CASE WHEN t = '' THEN 'empty_text' WHEN length(t) <= 120 AND NOT operative AND ({" OR ".join(f"contains(low, '{a}')" for a in P.ANCHORS)}) THEN 'cross_reference_dangling'
  WHEN NOT parent AND length(t) < 100 AND regexp_matches(t, '{P.LIST_START}') AND NOT operative THEN 'list_marker_bare' WHEN NOT parent AND length(t) < 80 AND NOT operative THEN 'short_inert'
  WHEN opener IS NOT NULL THEN 'deictic_prefix' WHEN parent AND contains(lower(fragment_locator), ':list:') THEN 'structured_list_parent_ok' END AS rule FROM o),
s AS (SELECT *, CASE WHEN rule IN ('empty_text', 'cross_reference_dangling', 'list_marker_bare', 'short_inert') THEN 'fragmentary' WHEN rule = 'deictic_prefix' THEN 'context_dependent' ELSE 'complete' END AS status,
  CASE WHEN rule = 'deictic_prefix' AND opener = 'instrument_identity' THEN instrument || substr(t, instr(low, ' ') + 1 + length(split_part(low, ' ', 2)))
       WHEN rule = 'deictic_prefix' AND opener = 'article_locator' AND starts_with(low, 'this article') THEN nullif(trim(article_reference), '') || substr(t, 13) END AS suggested FROM r)
SELECT 'pca-' || id AS assessment_id, id, status, rule, CASE WHEN status = 'fragmentary' THEN 'low' WHEN status = 'context_dependent' THEN CASE WHEN suggested IS NOT NULL THEN 'medium' ELSE 'low' END WHEN operative AND length(t) > 40 THEN 'high' ELSE 'medium' END AS confidence,
  CASE rule WHEN 'empty_text' THEN 'object' WHEN 'cross_reference_dangling' THEN 'cross_reference' WHEN 'list_marker_bare' THEN 'object' WHEN 'short_inert' THEN 'actor|object' WHEN 'deictic_prefix' THEN opener ELSE '' END AS missing_context, suggested FROM s
"""


def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EU propositions against UK ones, the nth of each user with the nth, and how each pair diverges."""
    rows = P.with_fields(law(spark, sf_dir)).select("user_id", "ord", "id", "proposition_text", "legal_subject", "action", "conditions", "authority", "required_documents")
    return P.divergence(P.pair_by_index(rows.filter("ord % 2 = 0"), rows.filter("ord % 2 = 1"), ["user_id"], ["ord"]))


DIVERGENCE_SQL = f"""
WITH {LAW_SQL},{FIELDS_SQL},
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS nth FROM fields WHERE ord % 2 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS nth, count(*) OVER (PARTITION BY user_id) AS last FROM fields WHERE ord % 2 = 1),
p AS (SELECT a.id AS id_a, b.id AS id_b, a.authority AS au_a, b.authority AS au_b, a.authority IS DISTINCT FROM b.authority AS au,
        CASE WHEN trim(a.proposition_text) = trim(b.proposition_text) THEN 'none' WHEN a.authority IS DISTINCT FROM b.authority AND a.action = b.action THEN 'institutional'
             WHEN list_sort(list_distinct(a.required_documents)) <> list_sort(list_distinct(b.required_documents)) THEN 'annex_model_certificate' WHEN a.conditions <> b.conditions THEN 'procedural'
             WHEN a.legal_subject <> b.legal_subject THEN 'definitional' WHEN a.action <> b.action THEN 'textual' ELSE 'structural' END AS divergence_type
      FROM a JOIN b ON a.user_id = b.user_id AND b.nth = least(a.nth, b.last))
SELECT 'finding-' || id_a || '-' || id_b AS finding_id, id_a, id_b, divergence_type, CASE WHEN divergence_type = 'none' OR au THEN 'high' ELSE 'medium' END AS confidence,
  CASE divergence_type WHEN 'institutional' THEN 'The propositions preserve a similar action, but the decision-maker differs: ' || coalesce(au_a, 'unspecified') || ' vs ' || coalesce(au_b, 'unspecified') || '.' {" ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in P.RATIONALES.items())} END AS rationale
FROM p
"""

#: Locators with their expected lineage key and whether they are coarse, as the rules of record give them.
LINEAGE_CASES = [
    ("article:109:list:1-d-i", "article:109:list:1-d-i"), ("eu:article:109:list:1__d", "article:109:list:1-d"), ("Article 109(1)(d)", "article:109:list:1-d"), ("Article 5(2)", "article:5:para:2"),
    ("article:5:para:2", "article:5:para:2"), ("article-5-para-2", "article:5:para:2"), ("article_109_1_d_i", "article:109:list:1-d-i"), ("document:full", None), ("", None), ("section:12", None), ("annex:II", None),
    ("article:7|chunk:003", None), ("recital:14", None), ("ns1:article:12a", None), ("Article 12A", None), ("article:109/extra", None),
]


def locator_lineage_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage key, type, coarseness and label of the locators of all fragments."""
    c = F.col("fragment_locator")
    return law(spark, sf_dir).select("id", c.alias("locator"), L.lineage_key(c).alias("lineage_key"), L.fragment_type(c).alias("fragment_type"), L.is_coarse(c).alias("coarse"), L.list_label(c).alias("label"))


LINEAGE_SQL = f"""
WITH {LAW_SQL},
known AS (SELECT * FROM (VALUES {", ".join(f"({_q(a)}, {_q(b) if b else 'NULL'})" for a, b in LINEAGE_CASES)}) t(locator, lineage_key))
SELECT id, fragment_locator AS locator, lineage_key,
  CASE WHEN fragment_locator = '' THEN 'unknown' WHEN fragment_locator = 'document:full' THEN 'document' WHEN contains(fragment_locator, '|chunk:') THEN 'chunk' WHEN starts_with(fragment_locator, 'article:') THEN 'article'
       WHEN starts_with(fragment_locator, 'annex:') THEN 'annex' WHEN starts_with(fragment_locator, 'section:') THEN 'section' WHEN starts_with(fragment_locator, 'recital:') THEN 'recital' ELSE 'unknown' END AS fragment_type,
  fragment_locator IN ('section:12', 'ns1:article:12a', 'article:109/extra') AS coarse,
  CASE fragment_locator WHEN 'article:109:list:1-d-i' THEN 'Art 109 §1(d)(i)' WHEN 'eu:article:109:list:1__d' THEN 'Art 109 §1(d)' END AS label
FROM law JOIN known ON locator = fragment_locator
"""

MESSAGES = [
    "429 Too Many Requests", "Insufficient credit balance", "quota exceeded", "context_window_exceeded: prompt too long", "unknown model alias x", "JSONDecodeError at line 1",
    "LLM invocation overloaded", "max tokens reached", "Validation failed", "Authorization: Bearer abc.def, api_key=XYZ123; done",
]
_MESSAGE = "CASE CAST(event_id % 10 AS INT) " + " ".join(f"WHEN {i} THEN {_q(m)}" for i, m in enumerate(MESSAGES)) + " END"


def repair_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed extraction chunks worth another call: class of failure, merged by user and type; secrets masked."""
    rows = spark.sql(f"SELECT event_id, user_id, event_type, {_MESSAGE} AS message FROM {{events}} WHERE event_id % 3 <> 0", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    rows = rows.withColumn("failure", P.repair_class(F.col("message"))).filter("failure IS NOT NULL OR message LIKE 'Auth%'").withColumn("message", T.redact(F.col("message")))
    longest = F.min_by("message", F.struct(-F.length("message"), F.col("event_id")))
    return rows.groupBy("user_id", "event_type").agg(longest.alias("reason"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("failure")), "|").alias("failures"), F.min("event_id").alias("first_event"))


REPAIR_SQL = f"""
WITH m AS (SELECT event_id, user_id, event_type, {_MESSAGE} AS message FROM events WHERE event_id % 3 <> 0),
c AS (SELECT *, CASE CAST(event_id % 10 AS INT) WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'insufficient_credits' WHEN 2 THEN 'quota' WHEN 3 THEN 'context_window' WHEN 4 THEN 'model_availability' WHEN 5 THEN 'json_parse_or_llm_failure' WHEN 6 THEN 'llm_call_failure' WHEN 7 THEN 'other_model_infra' END AS failure,
      CASE WHEN event_id % 10 = 9 THEN 'Authorization: Bearer [REDACTED], api_key=[REDACTED]; done' ELSE message END AS shown FROM m)
SELECT user_id, event_type, first(shown ORDER BY length(shown) DESC, event_id) AS reason, count(*) AS n, coalesce(string_agg(DISTINCT failure, '|' ORDER BY failure), '') AS failures, min(event_id) AS first_event
FROM c WHERE event_id % 10 <> 8 GROUP BY 1, 2
"""


def evidence_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a quote is found word for word in its source, and how."""
    rows = law(spark, sf_dir)
    quote = F.when(F.col("ord") % 3 == 0, F.upper(F.left("proposition_text", F.lit(30)))).when(F.col("ord") % 3 == 1, F.concat(F.lit("1) "), F.left("proposition_text", F.lit(25)))).otherwise("quite another text")
    return rows.select("id", T.evidence_match(quote, F.col("proposition_text")).alias("match"))


EVIDENCE_SQL = f"""
WITH {LAW_SQL}
SELECT id, CASE WHEN ord % 3 = 0 THEN 'plain' WHEN ord % 3 = 1 AND NOT starts_with(proposition_text, '(a) ') THEN 'list_marker' WHEN ord % 3 = 1 THEN 'list_marker' END AS match FROM law
"""


def guidance_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of guidance statements, by the rules for guidance."""
    c = F.col("proposition_text")
    rows = law(spark, sf_dir).filter(T.guidance_normative(c))
    return rows.select("id", T.guidance_subject(c).alias("subject"), T.guidance_action(c).alias("action"), F.array_join(T.guidance_conditions(c), "|").alias("conditions"), F.array_join(T.guidance_documents(c), "|").alias("documents"), T.jurisdiction_label(F.col("jurisdiction")).alias("jurisdiction"))


GUIDANCE_SQL = f"""
WITH {LAW_SQL}, g AS (SELECT *, lower(proposition_text) AS low FROM law WHERE {" OR ".join(f"contains(lower(proposition_text), {_q(w)})" for w in T.GUIDANCE_NORMATIVE)})
SELECT id, {_cases("low", [(w, _q(w)) for w in ("importer", "operator", "keeper", "you", "authority")], "'you'")} AS subject,
  CASE WHEN regexp_matches(proposition_text, '(?i)\\b(must not|must|shall not|shall|need to|are required to|ensure)\\b\\s+(\\w+)') THEN lower(regexp_extract(proposition_text, '(?i)\\b(must not|must|shall not|shall|need to|are required to|ensure)\\b\\s+(\\w+)', 1)) || ' ' || lower(regexp_extract(proposition_text, '(?i)\\b(must not|must|shall not|shall|need to|are required to|ensure)\\b\\s+(\\w+)', 2)) ELSE 'must comply' END AS action,
  array_to_string({_listed("low", [(m, f"trim(split_part(substr(proposition_text, instr(low, {_q(m)}), 80), ',', 1))") for m in T.GUIDANCE_CONDITIONS])}, '|') AS conditions,
  array_to_string({_listed("low", [(w, _q(w)) for w in T.GUIDANCE_DOCUMENTS])}, '|') AS documents,
  CASE upper(trim(jurisdiction)) WHEN 'EUROPEAN UNION' THEN 'EU' WHEN 'GB' THEN 'UK' WHEN '' THEN 'unknown' ELSE upper(trim(jurisdiction)) END AS jurisdiction FROM g
"""

def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined terms of all fragments, by priority."""
    return X.definitions(law(spark, sf_dir), "id", "proposition_text")


DEFINITIONS_SQL = f"""WITH {LAW_SQL} SELECT id, 0 AS ord, 'holding' AS term, 2 AS rank FROM law WHERE contains(proposition_text, '''holding'' means')"""


def fragment_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fragments are worth a model call, and why."""
    rows = law(spark, sf_dir).select("id", F.col("fragment_locator").alias("locator"), L.fragment_type(F.col("fragment_locator")).alias("fragment_type"), F.col("proposition_text").alias("fragment_text"))
    found = X.select_fragments(rows, required=["section:12", "article:7"], focus=["operator", "register", "competent authority"], include_annexes=True)
    return found.select("id", "selected", "reason")


SELECTION_SQL = f"""
WITH {LAW_SQL}, r AS (SELECT id, CASE WHEN fragment_locator IN ('section:12', 'article:7|chunk:003') THEN 'required_locator' WHEN fragment_locator = 'annex:II' THEN 'annex_included'
  WHEN contains(lower(proposition_text), 'competent authority') OR (contains(lower(proposition_text), 'operator') AND contains(lower(proposition_text), 'register')) THEN 'focus_term_match' WHEN length(proposition_text) < 40 THEN 'skipped_too_short'
  WHEN fragment_locator IN ('article:109:list:1-d-i', 'article:5:para:2', 'article:109/extra') THEN 'skipped_no_focus_match' ELSE 'skipped_non_operative' END AS reason FROM law)
SELECT id, NOT starts_with(reason, 'skipped') AS selected, reason FROM r
"""

QUERIES = {
    "definitions": (definitions, DEFINITIONS_SQL),
    "fragment_selection": (fragment_selection, SELECTION_SQL),
    "normative_sentences": (normative_sentences, NORMATIVE_SQL),
    "proposition_fields": (proposition_fields, PROPOSITION_FIELDS_SQL),
    "proposition_identity": (proposition_identity, PROPOSITION_IDENTITY_SQL),
    "categories_inventory": (categories_inventory, CATEGORIES_INVENTORY_SQL),
    "cross_reference_targets": (cross_reference_targets, CROSS_REFERENCE_SQL),
    "completeness": (completeness, COMPLETENESS_SQL),
    "divergence": (divergence, DIVERGENCE_SQL),
    "locator_lineage_key": (locator_lineage_key, LINEAGE_SQL),
    "repair_upsert": (repair_upsert, REPAIR_SQL),
    "evidence_trace": (evidence_trace, EVIDENCE_SQL),
    "guidance_fields": (guidance_fields, GUIDANCE_SQL),
}

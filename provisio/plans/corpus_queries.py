"""Queries over fragments, scopes, rules, groups, coverage and pages; with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import explorer as E
from ..operators import lint as Q
from ..operators import pages as G
from ..operators import propositions as P
from ..operators import scopes as S
from ..operators import splitting as X
from ..streaming import job_events as J
from .fixture import LAW_SQL, law
from .text_queries import FIELDS_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- splitting and budgets -------------------------------------------------------------------------------------------
def fragment_hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in windows of 1,200 characters that share 200."""
    cut = X.hard_split(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1200, 200)
    return cut.select("doc_id", "part", F.length("piece").alias("chars"), F.md5(F.col("piece").cast("binary")).alias("digest"))


HARD_SPLIT_SQL = """
WITH d AS (SELECT doc_id, trim(text, ' ') AS t FROM documents), s AS (SELECT doc_id, t, unnest(CASE WHEN length(t) <= 1200 THEN [0] ELSE generate_series(0, length(t) - 1, 1000) END) AS pos FROM d WHERE t <> '')
SELECT doc_id, CAST(pos // 1000 AS INT) AS part, CAST(length(substr(t, pos + 1, 1200)) AS INT) AS chars, md5(substr(t, pos + 1, 1200)) AS digest FROM s
"""


def token_budget_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens, calls and cost class of each source."""
    return X.budget(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")


BUDGET_SQL = """
WITH t AS (SELECT source, doc_id, CAST(greatest(1, ceil((length(coalesce(text, '')) + 1560) / 3.0)) AS BIGINT) AS tokens FROM documents),
g AS (SELECT source, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS total_tokens, max(tokens) AS max_tokens, first(doc_id ORDER BY tokens DESC, doc_id) AS largest_id, count(*) FILTER (tokens > 150000) AS over_budget FROM t GROUP BY 1)
SELECT *, CASE WHEN over_budget > 0 OR calls >= 48 OR max_tokens >= 180000 THEN 'very_large' WHEN calls >= 24 OR max_tokens >= 120000 THEN 'large' WHEN calls >= 12 OR max_tokens >= 80000 THEN 'medium' ELSE 'small' END AS cost_class FROM g
"""

_INSTRUMENT = "'Preamble of ' || p_name || chr(10) || 'Article 1' || chr(10) || 'The operator must keep ' || p_type || '.' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Article 2a Scope' || chr(10) || 'It applies to size ' || CAST(p_size AS STRING) || '.' END"


def heading_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments made of part names, cut at their article headings."""
    rows = spark.sql(f"SELECT p_partkey AS id, {_INSTRUMENT} AS body, CASE WHEN p_partkey % 2 = 0 THEN 'document:full' ELSE 'act:' || CAST(p_partkey AS STRING) END AS locator FROM {{part}}", part=_table(spark, sf_dir, "part"))
    return X.heading_split(rows, "body", "locator").select("id", "part", "fragment_locator", "fragment_text")


HEADING_SQL = """
WITH p AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS one, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'act:' || p_partkey END AS base, p_name, p_type, p_size FROM part)
SELECT id, 0 AS part, coalesce(base, 'document:full') AS fragment_locator, 'Preamble of ' || p_name || chr(10) || 'Article 1' || chr(10) || 'The operator must keep ' || p_type || '.' || chr(10) AS fragment_text FROM p WHERE one AND false
UNION ALL SELECT id, 0, coalesce(base, 'document:full'), rtrim('Preamble of ' || p_name || chr(10) || 'Article 1' || chr(10) || 'The operator must keep ' || p_type || '.' || chr(10), ' ') FROM p WHERE one
UNION ALL SELECT id, 0, coalesce(base, 'Article 1') || '|Article_1', 'Article 1' || chr(10) || 'The operator must keep ' || p_type || '.' || chr(10) FROM p WHERE NOT one
UNION ALL SELECT id, 1, coalesce(base, 'Article 2a Scope') || '|Article_2a_Scope', 'Article 2a Scope' || chr(10) || 'It applies to size ' || p_size || '.' FROM p WHERE NOT one
"""


def paragraph_overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed by paragraphs into chunks of 2,000 characters with 200 of overlap."""
    chunks = X.paragraph_overlap(_table(spark, sf_dir, "documents"), "doc_id", "text", 2000, 200)
    return chunks.select("id", "part", F.length("piece").alias("chars"))


def slice_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments made of part names, and documents as one-piece instruments, cut at their articles and to size."""
    rows = spark.sql(f"SELECT p_partkey AS id, {_INSTRUMENT} AS body, CASE WHEN p_partkey % 2 = 0 THEN 'full' ELSE 'act:' || CAST(p_partkey AS STRING) END AS locator FROM {{part}}", part=_table(spark, sf_dir, "part"))
    return X.plan_slices(rows, "id", "body", "locator", 4096, 512).drop("nth")


SLICE_SQL = """
WITH p AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS one, CASE WHEN p_partkey % 2 = 0 THEN 'document:full' ELSE 'act:' || p_partkey END AS base, p_name, p_type, p_size FROM part),
b AS (SELECT *, 'Preamble of ' || p_name || chr(10) || 'Article 1' || chr(10) || 'The operator must keep ' || p_type || '.' AS head, 'Article 2a Scope' || chr(10) || 'It applies to size ' || p_size || '.' AS rest FROM p)
SELECT id, 0 AS part, CASE WHEN one THEN base ELSE 'article:1' END AS locator, CASE WHEN one THEN head ELSE substr(head, instr(head, 'Article 1')) END AS piece, CASE WHEN one THEN 'monolith' ELSE 'article_plain' END AS strategy FROM b
UNION ALL SELECT id, 1, 'article:2a', rest, 'article_plain' FROM b WHERE NOT one
"""


_FORMS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 8 < 4 THEN ' ' ELSE 'act:' || CAST(p_partkey AS STRING) END AS locator, CASE CAST(p_partkey % 4 AS INT)
 WHEN 0 THEN '<act>' || p_brand || '<Article n="7">' || p_name || '</Article><eu:article>' || p_type || '</eu:article><article num=''09''>end</article></act>'
 WHEN 1 THEN 'Intro of ' || p_name || chr(10) || 'Section 1 Scope' || chr(10) || p_type || chr(10) || 'section 2. Rules' || chr(10) || p_brand || chr(10) || 'See Section 3'
 WHEN 2 THEN {long} ELSE 'Article 5' || chr(10) || p_name || chr(10) || 'no other article' END AS body FROM {part}"""
#: Five paragraphs of 1,000 characters: two fit into a chunk of 2,048.
_LONG = "chr(10) || " + " || chr(10) || chr(10) || ".join(f"rpad(p_name || ' paragraph {i} ', 999, 'x{i}') || '.'" for i in range(5))


def slice_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments with article tags, with sections, with long paragraphs and in one piece, cut to 2,048 characters."""
    rows = spark.sql(_FORMS.replace("{long}", _LONG), part=_table(spark, sf_dir, "part"))
    return X.plan_slices(rows, "id", "body", "locator", 2048).drop("nth")


FORMS_SQL = f"""
WITH p AS (SELECT *, CASE WHEN p_partkey % 8 < 4 THEN 'document:full' ELSE 'act:' || p_partkey END AS own FROM part),
x AS (SELECT p_partkey AS id, unnest([0, 1, 2, 3]) AS part, unnest(['article:1', 'article:7', 'article:3', 'article:09']) AS locator, unnest(['<act>' || p_brand, '<Article n="7">' || p_name || '</Article>', '<eu:article>' || p_type || '</eu:article>', '<article num=''09''>end</article></act>']) AS piece, 'article_xml' AS strategy FROM p WHERE p_partkey % 4 = 0),
s AS (SELECT p_partkey, unnest([0, 1]), unnest(['section:1', 'section:2.']), unnest(['Section 1 Scope' || chr(10) || p_type, 'section 2. Rules' || chr(10) || p_brand || chr(10) || 'See Section 3']), 'section_plain' FROM p WHERE p_partkey % 4 = 1),
l AS (SELECT p_partkey, 0, own || '|chunk:00' || unnest([0, 1, 2]), unnest([{", ".join(" || chr(10) || chr(10) || ".join(f"rpad(p_name || ' paragraph {i} ', 999, 'x{i}') || '.'" for i in pair) for pair in ((0, 1), (2, 3), (4,)))}]), 'monolith|chunk' FROM p WHERE p_partkey % 4 = 2)
SELECT * FROM x UNION ALL SELECT * FROM s UNION ALL SELECT * FROM l UNION ALL SELECT p_partkey, 0, own, 'Article 5' || chr(10) || p_name || chr(10) || 'no other article', 'monolith' FROM p WHERE p_partkey % 4 = 3
"""


def fragment_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fragments; those above 4,096 characters become slices that name their parent."""
    rows = _table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("source_record_id"), F.lit("full").alias("locator"), F.col("text").alias("fragment_text"))
    return X.expand_fragments(rows, 4096).select("id", "parent_id", "locator", "strategy", F.length("fragment_text").alias("chars"))


LIST = "1. The record shall hold:\n(a) the name;\n(b) for horses:\n(i) the code;\n(ii) the mark;\n(c) the date."


def structured_list_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standalone clauses of a lettered list, for every supplier's instrument."""
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(LIST).alias("body"), F.concat(F.lit("article:"), F.col("s_suppkey").cast("string")).alias("locator"))
    return X.structured_items(rows, "id", "body", "locator")


LIST_SQL = """
SELECT s_suppkey AS id, ord, 'article:' || s_suppkey || ':list:1-' || item AS item_locator, clause FROM supplier, (VALUES (0, 'a', 'The record shall hold the name'), (1, 'b-i', 'The record shall hold for horses the code'), (2, 'b-ii', 'The record shall hold for horses the mark'), (3, 'c', 'The record shall hold the date.')) v(ord, item, clause)
"""


# --- reuse and lineage by hash ---------------------------------------------------------------------------------------
def content_hash_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the earliest one with the same content, whose propositions it may reuse."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", T.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    first = docs.groupBy("content_hash").agg(F.min("doc_id").alias("reused_from"), F.count(F.lit(1)).alias("copies"))
    return docs.join(first, "content_hash").select("doc_id", "reused_from", "copies")


REUSE_SQL = "WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS reused_from, count(*) OVER (PARTITION BY h) AS copies FROM d"


def shared_hash_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content that stands under several sources and languages' worth of citations."""
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("citation"), T.content_hash(F.col("text")).alias("content_hash"))
    return Q.shared("docs", "content_hash", "id", "citation")({"docs": docs})


SHARED_SQL = "SELECT h AS id FROM (SELECT sha256(text) AS h, source, doc_id FROM documents) GROUP BY h HAVING count(DISTINCT source) > 1 AND count(DISTINCT doc_id) > 1"


# --- target links of sources -----------------------------------------------------------------------------------------
# Ordered rules (pattern, needs a reference to the target, link type, confidence).
LINK_RULES = [
    (r"\bcorrigendum\b", True, "corrects", "high"), (r"\bamending\b|\bamendment\b", True, "amends", "high"), (r"\bimplementing regulation\b", True, "implements", "high"),
    (r"\bdelegated regulation\b", True, "supplements", "high"), (r"\bexplanatory memorandum\b|\bexplanatory note", True, "explains", "high"),
]
_TITLES = ["Corrigendum to Act 2016/429", "Regulation amending Act 2016/429", "Implementing Regulation under Act 2016/429", "Delegated Regulation", "Explanatory note to Act 2016/429", "Guidance for keepers", "Guidance on Act 2016/429", "Model certificate", "Annex to Act 2016/429", "A study of Act 2016/429", "Other matter"]
_TITLE = "CASE CAST(s_suppkey % 11 AS INT) " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TITLES)) + " END"


def target_link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source is linked to the target act: ordered rules over title and citation."""
    rows = spark.sql(f"SELECT s_suppkey AS id, {_TITLE} AS title FROM {{s}}", s=_table(spark, sf_dir, "supplier"))
    low = F.lower("title")
    linked = F.contains(low, F.lit("2016/429"))
    link = F.when(F.col("id") == 1, F.struct(F.lit("is_target").alias("t"), F.lit("high").alias("c")))
    for pattern, needs, kind, confidence in LINK_RULES:
        link = link.when(low.rlike(pattern) & (linked if needs else F.lit(True)), F.struct(F.lit(kind).alias("t"), F.lit(confidence).alias("c")))
    pair = lambda t, c: F.struct(F.lit(t).alias("t"), F.lit(c).alias("c"))
    link = link.when(low.rlike(r"\bguidance\b"), F.when(linked, pair("explains", "medium")).otherwise(pair("contextual", "medium")))
    link = link.when(low.rlike(r"\bcertificate\b"), F.when(linked, pair("implements", "high")).otherwise(pair("contextual", "low")))
    link = link.when(low.rlike(r"\bannex\b") & linked, pair("contains_annex_to", "medium")).when(linked, pair("references", "medium")).otherwise(pair("unknown", "low"))
    return rows.withColumn("link", link).select("id", "title", F.col("link.t").alias("link_type"), F.col("link.c").alias("confidence"))


LINK_SQL = f"""
SELECT id, title, split_part(l, '/', 1) AS link_type, split_part(l, '/', 2) AS confidence FROM (SELECT s_suppkey AS id, {_TITLE} AS title, CASE WHEN s_suppkey = 1 THEN 'is_target/high' ELSE
  ['corrects/high', 'amends/high', 'implements/high', 'unknown/low', 'explains/high', 'contextual/medium', 'explains/medium', 'contextual/low', 'contains_annex_to/medium', 'references/medium', 'unknown/low'][s_suppkey % 11 + 1] END AS l FROM supplier)
"""


# --- scopes ----------------------------------------------------------------------------------------------------------
# The seed taxonomy: scope, parent, terms.
SCOPES = [
    ("animal", None, ["animal"]), ("terrestrial_animal", "animal", ["terrestrial"]), ("kept_terrestrial_animal", "terrestrial_animal", ["kept"]), ("equine", "kept_terrestrial_animal", ["equine", "equidae", "horse"]),
    ("bovine", "kept_terrestrial_animal", ["bovine", "cattle"]), ("identification_traceability", None, ["identified", "register", "transponder"]), ("certification", None, ["certificate", "licence"]), ("movement", None, ["movement", "consignment", "move"]),
]
_SCOPES_SQL = "scopes AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {repr(p) if p else 'NULL'}, {t!r})" for s, p, t in SCOPES) + ") v(scope_id, parent, terms))"


def _scopes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCOPES, "scope_id string, parent string, terms array<string>")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.link_scopes(P.with_fields(law(spark, sf_dir)), _scopes(spark))


def scope_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best evidence of each scope of the taxonomy in each proposition."""
    return _links(spark, sf_dir)


_PAD = "' ' || trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')) || ' '"
_SCOPE_LINK_SQL = f"""{_SCOPES_SQL},
tm AS (SELECT scope_id, unnest(terms) AS term FROM scopes),
pf AS (SELECT id, {_PAD.format("proposition_text")} AS f0, {_PAD.format("legal_subject")} AS f1, {_PAD.format("array_to_string(required_documents, ' ')")} AS f2, {_PAD.format("array_to_string(conditions, ' ')")} AS f3 FROM fields),
h AS (SELECT id, scope_id, term, CASE {" ".join(f"WHEN contains(f{i}, ' ' || term || ' ') OR contains(f{i}, ' ' || term || 's ') THEN {i}" for i in range(4))} END AS r FROM pf, tm),
sl AS (SELECT id, scope_id, r, term FROM (SELECT *, row_number() OVER (PARTITION BY id, scope_id ORDER BY r, length(term) DESC, term) AS place FROM h WHERE r IS NOT NULL) WHERE place = 1)"""
SCOPE_LINK_SQL = f"""
WITH {LAW_SQL},{FIELDS_SQL},{_SCOPE_LINK_SQL} SELECT id, scope_id, 'direct' AS relevance, CASE WHEN r < 2 THEN 'high' ELSE 'medium' END AS confidence, ['proposition_text', 'legal_subject', 'required_documents', 'conditions'][r + 1] AS field, term FROM sl
"""


def scope_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propositions of a scope and everything below it, for each scope."""
    links = _links(spark, sf_dir)
    down = S.closure(_scopes(spark), "scope_id", "parent")
    return links.join(down, F.col("scope_id") == F.col("descendant")).groupBy("ancestor").agg(F.countDistinct("id").alias("propositions"), F.max("depth").alias("deepest"))


DESCENDANTS_SQL = f"""
WITH RECURSIVE {LAW_SQL},{FIELDS_SQL},{_SCOPE_LINK_SQL},
down AS (SELECT scope_id AS ancestor, scope_id AS descendant, 0 AS depth FROM scopes UNION ALL SELECT ancestor, scope_id, depth + 1 FROM down JOIN scopes ON parent = descendant)
SELECT ancestor, count(DISTINCT id) AS propositions, max(depth) AS deepest FROM sl JOIN down ON scope_id = descendant GROUP BY 1
"""


def scope_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit and inherited links counted by scope and inheritance."""
    links = S.inherited(_links(spark, sf_dir), _scopes(spark), "scope_id", "parent")
    return S.scope_inventory(links, ["scope_id", "inheritance"])


INVENTORY_SQL = f"""
WITH RECURSIVE {LAW_SQL},{FIELDS_SQL},{_SCOPE_LINK_SQL},
up AS (SELECT scope_id AS descendant, parent AS ancestor FROM scopes WHERE parent IS NOT NULL UNION ALL SELECT descendant, parent FROM up JOIN scopes ON scope_id = ancestor WHERE parent IS NOT NULL),
al AS (SELECT id, scope_id, 'explicit' AS inheritance FROM sl UNION ALL SELECT DISTINCT id, ancestor, 'inherited' FROM sl JOIN up ON scope_id = descendant WHERE (id, ancestor) NOT IN (SELECT id, scope_id FROM sl))
SELECT 'scope_id' AS dim, scope_id AS key, count(*) AS n FROM al GROUP BY 2 UNION ALL SELECT 'inheritance', inheritance, count(*) FROM al GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*) FROM al
"""


# --- rules and gates -------------------------------------------------------------------------------------------------
def _bundle(spark: SparkSession, sf_dir: str) -> Q.Tables:
    """A run with faults: sources, snapshots and fragments are missing for some propositions."""
    props = law(spark, sf_dir)
    sources = props.select(F.col("source_record_id").alias("id")).distinct().filter("id <> 'src-4'").withColumns({"content_hash": F.when(F.col("id").isin("src-1", "src-2"), "same").otherwise(F.col("id")), "citation": F.col("id"), "current_snapshot_id": F.when(F.col("id") < "src-3", "snap-x").otherwise(F.col("id"))})
    snapshots = props.select(F.col("source_snapshot_id").alias("id")).distinct().filter("id NOT LIKE '%-v2'").withColumns({"parser_name": F.lit("xml"), "parser_version": F.when(F.col("id") == "snap-0-v0", "").otherwise("1")})
    fragments = props.filter("source_fragment_id IS NOT NULL AND source_fragment_id <> 'frag-7'").groupBy(F.col("source_fragment_id").alias("id")).agg(F.min("source_record_id").alias("source_record_id"), F.min("source_snapshot_id").alias("source_snapshot_id"), F.min("fragment_locator").alias("locator"))
    fragments = fragments.withColumns({"fragment_type": F.when(F.col("id") == "frag-3", "page").otherwise("article"), "text_hash": F.when(F.col("id") == "frag-9", "").otherwise(F.col("id"))})
    return {"propositions": props, "sources": sources, "snapshots": snapshots, "fragments": fragments}


USED = ["L5", "L6", "L7", "L8", "L9", "L10", "L29", "L31", "L33", "L34", "L35", "L37", "L38", "L43", "L44"]


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.lint(_bundle(spark, sf_dir), [c for c in Q.RUN_CHECKS if c.code in USED])


def lint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the rules that the run's tables allow."""
    return _findings(spark, sf_dir)


_FINDINGS_SQL = f"""{LAW_SQL},
so AS (SELECT DISTINCT source_record_id AS id FROM law WHERE source_record_id <> 'src-4'), sn AS (SELECT DISTINCT source_snapshot_id AS id FROM law WHERE source_snapshot_id NOT LIKE '%-v2'),
fr AS (SELECT source_fragment_id AS id, min(source_record_id) AS s, min(source_snapshot_id) AS n, min(fragment_locator) AS l FROM law WHERE source_fragment_id IS NOT NULL AND source_fragment_id <> 'frag-7' GROUP BY 1),
f AS (SELECT 'L6' AS code, id FROM law WHERE source_record_id NOT IN (SELECT id FROM so) UNION ALL SELECT 'L8', id FROM law WHERE source_snapshot_id NOT IN (SELECT id FROM sn)
  UNION ALL SELECT 'L9', id FROM law WHERE source_fragment_id IS NOT NULL AND source_fragment_id NOT IN (SELECT id FROM fr) UNION ALL SELECT 'L10', law.id FROM law JOIN fr ON source_fragment_id = fr.id WHERE source_snapshot_id <> n
  UNION ALL SELECT 'L29', id FROM sn WHERE id = 'snap-0-v0' UNION ALL SELECT 'L31', id FROM fr WHERE s NOT IN (SELECT id FROM so) UNION ALL SELECT 'L33', id FROM fr WHERE n NOT IN (SELECT id FROM sn)
  UNION ALL SELECT 'L34', id FROM fr WHERE id = 'frag-9' UNION ALL SELECT 'L35', id FROM fr WHERE id = 'frag-3' UNION ALL SELECT 'L37', id FROM fr WHERE l = ''
  UNION ALL SELECT 'L43', 'same' WHERE (SELECT count(*) FROM so WHERE id IN ('src-1', 'src-2')) = 2 UNION ALL SELECT 'L44', 'snap-x' WHERE (SELECT count(*) FROM so WHERE id IN ('src-1', 'src-2')) = 2),
known AS (SELECT * FROM (VALUES {", ".join(f"('{c.code}', '{c.severity}', '{c.gate}', '{c.message}')" for c in Q.RUN_CHECKS)}) t(code, severity, gate, said)),
fi AS (SELECT code, severity, gate, id, said || ': ' || id AS message FROM f JOIN known USING (code))"""
LINT_SQL = f"WITH {_FINDINGS_SQL} SELECT code, severity, gate, id, message FROM fi"


def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quality gate with its counts and status."""
    names = spark.createDataFrame([(g,) for g in sorted({c.gate for c in Q.RUN_CHECKS})], "gate string")
    return Q.gates(_findings(spark, sf_dir), names)


GATES_SQL = f"""
WITH {_FINDINGS_SQL}, g AS (SELECT gate, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(DISTINCT id) AS affected, min(message) AS message FROM fi GROUP BY 1)
SELECT n.gate, CASE WHEN errors > 0 THEN 'fail' WHEN warnings > 0 THEN 'pass_with_warnings' ELSE 'pass' END AS status, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(affected, 0) AS affected, message FROM (SELECT DISTINCT gate FROM known) n LEFT JOIN g USING (gate)
"""


# --- explorer --------------------------------------------------------------------------------------------------------
def explorer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of propositions of one lineage, coarse parents left out."""
    return E.groups(E.without_coarse_parents(E.with_keys(law(spark, sf_dir))))


def explorer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 50 groups in the order of the explorer, of propositions that hold "operator" or "keeper"."""
    rows = E.with_keys(law(spark, sf_dir).filter(E.matches_search("operator", "proposition_text", "id") | E.matches_search("keeper", "proposition_text")))
    return E.sorted_page(E.groups(E.without_coarse_parents(rows)), 50, 50)


def coarse_parent_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the coarse propositions that stay in the default view."""
    kept = E.without_coarse_parents(E.with_keys(law(spark, sf_dir)))
    return kept.filter(F.col("cluster").startswith("section:") | F.col("fragment_locator").isin("article:109/extra", "ns1:article:12a")).select("id", "cluster")


_ARTICLE_NUMBER = "CASE WHEN article_reference = '' THEN NULL ELSE 'article:' || substr(article_reference, 9) END"
_KEYS_SQL = f"""{LAW_SQL},
lin AS (SELECT * FROM (VALUES ('article:109:list:1-d-i', 'article:109:list:1-d-i', 'article:109'), ('eu:article:109:list:1__d', 'article:109:list:1-d', 'article:109'), ('Article 109(1)(d)', 'article:109:list:1-d', 'article:109'), ('Article 5(2)', 'article:5:para:2', 'article:5'),
  ('article:5:para:2', 'article:5:para:2', 'article:5'), ('article-5-para-2', 'article:5:para:2', 'article:5'), ('article_109_1_d_i', 'article:109:list:1-d-i', 'article:109'), ('document:full', NULL, NULL), ('', NULL, NULL), ('section:12', NULL, 'section:12'),
  ('annex:II', NULL, 'loc'), ('article:7|chunk:003', NULL, 'article:7'), ('recital:14', NULL, 'loc'), ('ns1:article:12a', NULL, 'article:12a'), ('Article 12A', NULL, 'article:12a'), ('article:109/extra', NULL, 'article:109')) v(fragment_locator, lineage, clus)),
k AS (SELECT law.*, lineage, fragment_locator IN ('section:12', 'ns1:article:12a', 'article:109/extra') AS coarse,
  CASE WHEN clus = 'loc' THEN coalesce({_ARTICLE_NUMBER}, 'loc:' || lower(fragment_locator)) WHEN clus IS NULL THEN coalesce({_ARTICLE_NUMBER}, 'none') ELSE clus END AS cluster FROM law JOIN lin USING (fragment_locator)),
vis AS (SELECT * FROM k WHERE NOT coarse OR NOT EXISTS (SELECT 1 FROM k c WHERE c.source_record_id = k.source_record_id AND starts_with(c.lineage, k.cluster || ':list:')))"""
COARSE_SQL = f"WITH {_KEYS_SQL} SELECT id, cluster FROM vis WHERE starts_with(cluster, 'section:') OR fragment_locator IN ('article:109/extra', 'ns1:article:12a')"
_GROUPS = r"""
gr AS (SELECT source_record_id || chr(31) || CASE WHEN lineage IS NOT NULL THEN 'lineage:' || lineage WHEN coarse THEN 'coarse:' || cluster || ':' || left(sha256(replace(regexp_replace(lower(trim(regexp_replace(proposition_text, '\s+', ' ', 'g'))), '\bshall\b', 'must', 'g'), 'that the information', 'that information')), 16) ELSE 'id:' || id END AS group_key, cluster,
  count(*) AS n_rows, count(DISTINCT trim(regexp_replace(proposition_text, '\s+', ' ', 'g'))) AS wordings, string_agg(DISTINCT j, '|' ORDER BY j) AS jurisdictions, min(id) AS first_id
  FROM (SELECT *, CASE upper(trim(jurisdiction)) WHEN 'EUROPEAN UNION' THEN 'EU' WHEN 'GB' THEN 'UK' WHEN '' THEN 'unknown' ELSE upper(trim(jurisdiction)) END AS j FROM vis) GROUP BY 1, 2)
SELECT *, CASE WHEN n_rows = 1 THEN 'single' WHEN wordings = 1 THEN 'same' ELSE 'different' END AS wording_status FROM gr"""
GROUPS_SQL = f"WITH {_KEYS_SQL},{_GROUPS}"
_SEARCHED = _KEYS_SQL.replace("law JOIN lin", "(SELECT * FROM law WHERE contains(lower(proposition_text), 'operator') OR contains(lower(proposition_text), 'keeper')) law JOIN lin")
PAGE_SQL = f"""
WITH {_SEARCHED},{_GROUPS}
ORDER BY CASE WHEN starts_with(cluster, 'article:') THEN 0 WHEN starts_with(cluster, 'section:') THEN 1 WHEN cluster = 'none' THEN 3 ELSE 2 END, TRY_CAST(nullif(regexp_extract(cluster, ':(\\d+)', 1), '') AS INT) NULLS LAST, regexp_extract(cluster, ':\\d+([a-z]?)', 1), cluster, group_key LIMIT 50 OFFSET 50
"""


# --- coverage and metrics --------------------------------------------------------------------------------------------
def coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources with what came of them: orders, open ones, the last date, and why a source has none."""
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.max("o_orderdate").cast("date").alias("last_date"))
    rows = _table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    bucket = F.when(F.col("c_mktsegment") == "MACHINERY", "excluded").when(zero("n_orders") == 0, "pending").otherwise("included")
    return rows.select("c_custkey", zero("n_orders").alias("n_orders"), zero("n_open").alias("n_open"), "last_date", bucket.alias("bucket"))


_COVERAGE = "SELECT c_custkey, count(o_orderkey) AS n_orders, count(*) FILTER (o_orderstatus = 'O') AS n_open, CAST(max(o_orderdate) AS DATE) AS last_date, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'excluded' WHEN count(o_orderkey) = 0 THEN 'pending' ELSE 'included' END AS bucket FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment"
COVERAGE_SQL = _COVERAGE


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts of the coverage rows by bucket."""
    return coverage_rows(spark, sf_dir).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_orders").alias("n_orders"), F.count_if(F.col("n_open") > 0).alias("with_open"), F.min("last_date").alias("oldest"))


SUMMARY_SQL = f"SELECT bucket, count(*) AS n, CAST(sum(n_orders) AS BIGINT) AS n_orders, count(*) FILTER (n_open > 0) AS with_open, min(last_date) AS oldest FROM ({_COVERAGE}) GROUP BY 1"


def fetch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch attempts by day: hits, successes, retries, failures, distinct hashes."""
    e = _table(spark, sf_dir, "events")
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("attempts"), n("view").alias("cache_hits"), n("purchase").alias("successes"), n("click").alias("retryable"), n("error").alias("fatal"), F.countDistinct("props").alias("hashes"))


FETCH_SQL = "SELECT CAST(ts AS DATE) AS day, count(*) AS attempts, count(*) FILTER (event_type = 'view') AS cache_hits, count(*) FILTER (event_type = 'purchase') AS successes, count(*) FILTER (event_type = 'click') AS retryable, count(*) FILTER (event_type = 'error') AS fatal, count(DISTINCT props) AS hashes FROM events GROUP BY 1"


def job_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job events by day and type."""
    return J.event_counts(_table(spark, sf_dir, "events"))


JOBS_SQL = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


# --- pages -----------------------------------------------------------------------------------------------------------
def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of all pages."""
    return G.html_lines(_table(spark, sf_dir, "pages"))


def text_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words added and removed between a turn and the one two turns before."""
    c = _table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("before"))
    return G.word_diff(c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", "before", "text"), "before", "text").drop("before", "text")


QUERIES = {
    "fragment_hard_split": (fragment_hard_split, HARD_SPLIT_SQL),
    "token_budget_cost": (token_budget_cost, BUDGET_SQL),
    "heading_split": (heading_split, HEADING_SQL),
    "paragraph_overlap_chunks": (paragraph_overlap_chunks, None),
    "slice_plan": (slice_plan, SLICE_SQL),
    "slice_forms": (slice_forms, FORMS_SQL),
    "fragment_expansion": (fragment_expansion, None),
    "structured_list_drafts": (structured_list_drafts, LIST_SQL),
    "content_hash_reuse": (content_hash_reuse, REUSE_SQL),
    "shared_hash_lint": (shared_hash_lint, SHARED_SQL),
    "target_link_rules": (target_link_rules, LINK_SQL),
    "scope_link": (scope_link, SCOPE_LINK_SQL),
    "scope_descendants": (scope_descendants, DESCENDANTS_SQL),
    "scope_inventory": (scope_inventory, INVENTORY_SQL),
    "lint_rules": (lint_rules, LINT_SQL),
    "quality_gates": (quality_gates, GATES_SQL),
    "explorer_groups": (explorer_groups, GROUPS_SQL),
    "explorer_page": (explorer_page, PAGE_SQL),
    "coarse_parent_suppression": (coarse_parent_suppression, COARSE_SQL),
    "coverage_rows": (coverage_rows, COVERAGE_SQL),
    "coverage_summary": (coverage_summary, SUMMARY_SQL),
    "fetch_metrics": (fetch_metrics, FETCH_SQL),
    "job_event_counts": (job_event_counts, JOBS_SQL),
    "html_lines": (html_lines, None),
    "text_diff": (text_diff, None),
}

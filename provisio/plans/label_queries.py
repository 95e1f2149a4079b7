"""Queries over small rules and headings, with the DuckDB SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import splitting as X
from .scope_queries import TAXONOMY, _tables

_ROWS = """SELECT event_id AS id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'Regulation 2016 / 429 and 2019/2035' WHEN 1 THEN 'see 1999/12' WHEN 2 THEN NULL WHEN 3 THEN 'x 2021/77 then 2020/1234' ELSE event_type || '  2018/848' END AS citation, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ' a  label ' END AS label,
 CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'recital' WHEN 1 THEN NULL WHEN 2 THEN 'table' ELSE 'article' END AS fragment_type, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'draft' WHEN 1 THEN 'accepted' WHEN 2 THEN 'in_review' WHEN 3 THEN 'accepted_with_edits' END AS status, 'key' || CASE WHEN event_id % 2 = 0 THEN chr(30) || 'article:1' ELSE '' END AS group_key,
 event_id * 3 AS max_tokens, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN NULL ELSE 'high' END AS confidence, CASE WHEN event_id % 9 = 0 THEN 'fragmentary' WHEN event_id % 9 = 1 THEN NULL ELSE 'complete' END AS completeness, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'https://www.gov.uk/guidance/' || event_type || '/#part' WHEN 1 THEN 'http://www.gov.uk/x//' WHEN 2 THEN '/y' ELSE NULL END AS address,
 CASE WHEN event_id % 8 = 0 THEN 'fixture-1' ELSE 'src' END AS source_id, CASE WHEN event_id % 10 = 0 THEN 'Note: Discovery candidate only.' END AS reason FROM {events}"""


def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, fingerprints, states, budgets and addresses of made-up rows."""
    c = F.col
    rows = spark.sql(_ROWS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.select(
        "id", L.instrument_token(c("citation")).alias("token"), L.wording_fingerprint(c("citation"), c("label")).alias("fingerprint"), L.is_operative_type(c("fragment_type")).alias("operative"), L.canonical_status(c("status")).alias("state"), L.without_subgroup(c("group_key")).alias("bare_key"),
        L.body_chars(c("max_tokens")).cast("long").alias("body_chars"), L.guidance_blocks(c("status"), c("confidence"), c("completeness")).alias("blocks"), L.content_address(c("address")).alias("content_address"), L.source_bucket(c("source_id"), c("reason")).alias("bucket"),
    )


def scope_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which scopes a filter of the explorer names: filters are the types of events and names of scopes."""
    scopes = _tables(spark, sf_dir)[2]
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.explode(F.array(F.col("event_type"), *map(F.lit, ["", " HORSE", "Kept terrestrial animal", "movement_control", "tagging "]))).alias("wanted")).distinct()
    met = asked.join(F.broadcast(scopes), L.scope_matches(F.col("wanted"), F.col("scope_id"), F.col("slug"), F.col("label"), F.col("synonyms")))  # a taxonomy of eleven rows
    return met.select("wanted", "scope_id")


def document_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut at lines that look like headings."""
    found = X.text_headings(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "ord", "heading", F.length("body").alias("chars"), F.md5(F.col("body").cast("binary")).alias("digest"))


_BLOCKS = """concat_ws('; ', CASE WHEN coalesce(confidence, '') <> 'high' THEN 'extraction confidence is ''' || coalesce(confidence, '') || ''', not high' END, CASE WHEN coalesce(status, '') NOT IN ('accepted', 'accepted_with_edits') THEN 'review_status is ''' || coalesce(status, '') || ''' (needs accepted decision)' END, CASE WHEN completeness = 'fragmentary' THEN 'completeness is fragmentary' END)"""
RULES_SQL = rf"""
SELECT id, CASE WHEN regexp_matches(citation, '\b20\d{{2}}\s*/\s*\d{{3,4}}\b') THEN regexp_extract(citation, '\b(20\d{{2}})\s*/\s*(\d{{3,4}})\b', 1) || '/' || regexp_extract(citation, '\b(20\d{{2}})\s*/\s*(\d{{3,4}})\b', 2) END AS token,
 trim(regexp_replace(coalesce(citation, ''), '\s+', ' ', 'g')) || chr(31) || trim(regexp_replace(coalesce(label, ''), '\s+', ' ', 'g')) AS fingerprint, coalesce(fragment_type, '') NOT IN ('recital', 'table') AS operative, CASE WHEN status IN ('draft', 'in_review') THEN 'proposed' ELSE status END AS state, split_part(group_key, chr(30), 1) AS bare_key,
 greatest(4096, 3 * greatest(128, greatest(256, max_tokens - 2048) - 520))::BIGINT AS body_chars, {_BLOCKS} AS blocks, 'https://www.gov.uk/api/content' || rtrim(split_part(regexp_replace(coalesce(address, ''), 'https?://www[.]gov[.]uk', ''), '#', 1), '/') AS content_address, CASE WHEN source_id = 'fixture-1' THEN 'fixture' WHEN reason IS NOT NULL THEN 'discovery' ELSE 'included' END AS bucket FROM ({_ROWS.format(events="events")})"""
_NAMES = ", ".join(f"('{s[0]}', '{n.lower()}')" for s in TAXONOMY for n in (s[0], s[1], *s[4]))
SCOPES_SQL = f"""
WITH w AS (SELECT DISTINCT unnest([event_type, '', ' HORSE', 'Kept terrestrial animal', 'movement_control', 'tagging ']) AS wanted FROM events), n AS (SELECT * FROM (VALUES {_NAMES}) v(scope_id, name))
SELECT DISTINCT wanted, scope_id FROM w JOIN n ON trim(wanted) = '' OR lower(trim(wanted)) = name"""
HEADINGS_SQL = r"""
WITH l AS (SELECT row, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS nth FROM (SELECT row_number() OVER () AS row, doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents)),
b AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare FROM l), h AS (SELECT *, CASE WHEN length(bare) < 80 AND regexp_matches(bare, '^\p{Lu}') AND NOT ends_with(bare, '.') AND len(string_split_regex(bare, '\s+')) <= 10 THEN bare END AS heading FROM b),
r AS (SELECT *, count(heading) OVER (PARTITION BY row ORDER BY nth ROWS UNBOUNDED PRECEDING) AS ord FROM h),
g AS (SELECT doc_id, ord, coalesce(max(heading), 'Introduction') AS heading, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (heading IS NULL), ''), '^\s+|\s+$', '', 'g') AS body FROM r GROUP BY row, doc_id, ord)
SELECT doc_id, ord, heading, length(body)::INTEGER AS chars, md5(body) AS digest FROM g WHERE body <> ''"""

QUERIES = {"small_rules": (small_rules, RULES_SQL), "scope_filters": (scope_filters, SCOPES_SQL), "document_headings": (document_headings, HEADINGS_SQL)}

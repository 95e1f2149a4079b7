"""Queries over merged explorer groups, with the DuckDB SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explorer as E
from ..operators import explorer_merge as M
from .corpus_queries import _KEYS_SQL
from .fixture import law
from .scope_queries import TAXONOMY, _text

_ADDED = [
    "'key-' || CAST(ord % 3 AS STRING) AS proposition_key",
    "CASE WHEN ord % 13 = 0 THEN '' WHEN ord % 3 = 0 THEN 'Accepted' ELSE 'generated' END AS effective_status",
    "CASE WHEN ord % 2 = 0 THEN 'duty' ELSE 'power' END AS kind",
    "CASE WHEN ord % 10 = 0 THEN 'label ' || CAST(ord % 4 AS STRING) ELSE '' END AS label",
]
_MORE = ", ".join(_ADDED)
_LINKS = """SELECT id, element AS scope_id, CASE WHEN ord % 7 = 0 THEN 'contextual' ELSE 'direct' END AS relevance, CASE WHEN ord % 4 = 0 THEN 'low' ELSE 'high' END AS confidence
 FROM (SELECT id, ord, CASE CAST(ord % 6 AS INT) WHEN 0 THEN 'equine' WHEN 1 THEN 'animal' WHEN 2 THEN 'bovine' WHEN 3 THEN 'movement_control' WHEN 4 THEN 'unlisted' ELSE '' END AS element FROM {law}
 UNION ALL SELECT id, ord, 'certification' FROM {law} WHERE ord % 5 = 1) WHERE element <> ''"""
_COMPLETE = "SELECT id, CASE WHEN ord % 3 = 0 THEN 'complete' ELSE 'fragment' END AS status FROM {law} WHERE ord % 8 < 3"
_TRACES = "SELECT id, 'trace-' || id AS artifact_id FROM {law} WHERE ord % 2 = 1"
_DECISIONS = "SELECT CASE WHEN ord % 3 = 0 THEN 'proposition' ELSE 'proposition_extraction_trace' END AS artifact_type, CASE WHEN ord % 3 = 0 THEN id ELSE 'trace-' || id END AS artifact_id, 'accepted' AS decision FROM {law} WHERE ord % 5 = 0"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All propositions with their keys, the subgroups of those that are shown, scope links."""
    props = law(spark, sf_dir)
    universe = E.with_keys(props.selectExpr("*", *_ADDED))
    return universe, M.subgroups(E.without_coarse_parents(universe)), spark.sql(_LINKS, law=props)


def _scopes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s[0], s[0], s[1]) for s in TAXONOMY], "scope_id string, slug string, label string")


def explorer_merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each group after merging those that say the same."""
    _, rows, links = _tables(spark, sf_dir)
    return M.summaries(M.merged(rows, links), links, _scopes(spark), spark.sql(_COMPLETE, law=law(spark, sf_dir)))


def explorer_merge_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, artefacts, locators and keys that went into merged groups."""
    _, rows, links = _tables(spark, sf_dir)
    return M.merge_members(rows, M.merged(rows, links))


def explorer_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article sections with their groups and the coarse parents left out of them."""
    universe, rows, links = _tables(spark, sf_dir)
    return M.sections(M.merged(rows, links), universe)


def explorer_scope_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by scope bucket."""
    return M.scope_sections(explorer_merged_groups(spark, sf_dir))


def explorer_group_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that belongs to the merged group with the least key among those of most rows."""
    _, rows, links = _tables(spark, sf_dir)
    found, props = M.merged(rows, links), law(spark, sf_dir)
    sizes = found.groupBy("merged_key").agg(F.count(F.lit(1)).alias("n"))
    group = sizes.orderBy(F.desc("n"), "merged_key").first()
    return M.group_detail(found, group.merged_key if group else "", links, *(spark.sql(q, law=props) for q in (_COMPLETE, _TRACES, _DECISIONS)))


_SQUASHED = r"trim(regexp_replace(proposition_text, '\s+', ' ', 'g'))"
_WORDING = rf"replace(regexp_replace(lower({_SQUASHED}), '\bshall\b', 'must', 'g'), 'that the information', 'that information')"
_LABEL = "CASE upper(trim(jurisdiction)) WHEN 'EUROPEAN UNION' THEN 'EU' WHEN 'GB' THEN 'UK' WHEN '' THEN 'unknown' ELSE upper(trim(jurisdiction)) END"
_MERGED_SQL = f"""{_KEYS_SQL},
links AS ({_LINKS.format(law="law")}), complete AS ({_COMPLETE.format(law="law")}), traces AS ({_TRACES.format(law="law")}), decisions AS ({_DECISIONS.format(law="law")}),
scopes AS (SELECT * FROM (VALUES {", ".join(f"('{s[0]}', {_text(s[1])})" for s in TAXONOMY)}) v(scope_id, label)),
rows0 AS (SELECT *, {_LABEL} AS j, {_MORE}, source_record_id || chr(31) || CASE WHEN lineage IS NOT NULL THEN 'lineage:' || lineage WHEN coarse THEN 'coarse:' || cluster || ':' || left(sha256({_WORDING}), 16) ELSE 'id:' || id END AS group_key FROM vis),
rows1 AS (SELECT *, CASE WHEN min(cluster) OVER (PARTITION BY group_key) = max(cluster) OVER (PARTITION BY group_key) THEN group_key ELSE group_key || chr(30) || cluster END AS sub_key FROM rows0),
prim AS (SELECT id, string_agg(scope_id, ',' ORDER BY scope_id) AS sig FROM links WHERE relevance = 'direct' AND confidence = 'high' GROUP BY 1),
keyed AS (SELECT rows1.*, concat_ws(chr(29), source_record_id, lower(trim(jurisdiction)), cluster, coalesce(lineage, '__no_lineage__:' || trim(fragment_locator) || ':' || proposition_key), {_WORDING}, lower(effective_status), kind, coalesce(sig, '')) AS row_key FROM rows1 LEFT JOIN prim USING (id)),
signed AS (SELECT sub_key, string_agg(row_key, chr(30) ORDER BY row_key) AS sig FROM keyed GROUP BY 1),
names AS (SELECT sub_key, min(sub_key) OVER (PARTITION BY sig) AS merged_key, count(*) OVER (PARTITION BY sig) AS merged_groups FROM signed),
merged AS (SELECT keyed.*, merged_key, merged_groups, CASE j WHEN 'EU' THEN 0 WHEN 'UK' THEN 1 ELSE 2 END AS jr FROM keyed JOIN names USING (sub_key))"""
_SUMMARY_SQL = f"""{_MERGED_SQL},
hist AS (SELECT merged_key, string_agg(st || '=' || n, '|' ORDER BY st || '=' || n) AS review_summary FROM (SELECT merged_key, CASE WHEN effective_status = '' THEN 'unknown' ELSE lower(effective_status) END AS st, count(*) AS n FROM merged GROUP BY 1, 2) GROUP BY 1),
jur AS (SELECT merged_key, string_agg(j, '|' ORDER BY jr, j) AS jurisdictions FROM (SELECT DISTINCT merged_key, j, jr FROM merged WHERE j <> 'unknown') GROUP BY 1),
sl AS (SELECT merged_key, scope_id, min({{'r': jr, 's': source_record_id, 'o': ord, 'l': scope_id}}) AS o, min(coalesce(label, scope_id)) AS label FROM (SELECT merged_key, jr, source_record_id, ord, scope_id, scopes.label FROM merged JOIN links USING (id) LEFT JOIN scopes USING (scope_id) WHERE relevance = 'direct' AND confidence = 'high') GROUP BY 1, 2),
sg AS (SELECT merged_key, list(scope_id ORDER BY o) AS scope_slugs, min(scope_id) AS least, arg_min(label, scope_id) AS least_label FROM sl GROUP BY 1),
base AS (SELECT merged_key, max(merged_groups) AS merged_groups, count(*) AS n_rows, min(m.id) AS first_id, arg_min(lineage, {{'r': jr, 's': source_record_id, 'o': ord}}) FILTER (lineage IS NOT NULL) AS canonical_lineage, count(DISTINCT {_SQUASHED}) AS wordings,
  arg_min(status, {{'r': jr, 's': source_record_id, 'o': ord}}) FILTER (status IS NOT NULL) AS completeness_status FROM merged m LEFT JOIN complete USING (id) GROUP BY 1),
summary AS (SELECT merged_key, merged_groups, n_rows, first_id, canonical_lineage, coalesce(jurisdictions, '') AS jurisdictions, CASE WHEN n_rows = 1 THEN 'single' WHEN wordings = 1 THEN 'same' ELSE 'diff' END AS wording_status, review_summary, completeness_status,
  coalesce(scope_slugs, []) AS scope_slugs, coalesce('scope:' || least, 'scope:__none__') AS bucket, coalesce(least_label, 'Unscoped / other') AS bucket_label FROM base JOIN hist USING (merged_key) LEFT JOIN jur USING (merged_key) LEFT JOIN sg USING (merged_key))"""
_MEMBERS_SQL = """SELECT DISTINCT merged_key, kind, value FROM (SELECT merged_key, 'group' AS kind, sub_key AS value FROM merged WHERE merged_groups > 1 UNION ALL SELECT merged_key, 'artifact', id FROM merged WHERE merged_groups > 1
  UNION ALL SELECT merged_key, 'proposition_key', proposition_key FROM merged WHERE merged_groups > 1
  UNION ALL SELECT merged_key, 'locator', unnest([trim(fragment_locator), CASE WHEN article_reference <> '' THEN 'article_ref:' || article_reference ELSE '' END, CASE WHEN label <> '' THEN 'label:' || label ELSE '' END, 'article_cluster:' || cluster]) FROM merged WHERE merged_groups > 1) WHERE value <> ''"""
_SECTIONS_SQL = "SELECT cluster, min(ord) AS first_ord, count(DISTINCT merged_key) AS n_groups, count(*) AS n_rows, coalesce((SELECT count(*) FROM k WHERE k.cluster = m.cluster AND k.id NOT IN (SELECT id FROM vis)), 0) AS suppressed FROM merged m GROUP BY cluster"
_DETAIL_SQL = f"""{_MERGED_SQL}, pick AS (SELECT merged_key FROM merged GROUP BY 1 ORDER BY count(*) DESC, merged_key LIMIT 1), mine AS (SELECT * FROM merged WHERE merged_key = (SELECT merged_key FROM pick))
SELECT 'proposition' AS kind, id, proposition_text AS value FROM mine UNION ALL SELECT DISTINCT 'scope_link', id, scope_id FROM links SEMI JOIN mine USING (id) UNION ALL SELECT 'completeness', id, status FROM complete SEMI JOIN mine USING (id)
UNION ALL SELECT 'trace', id, artifact_id FROM traces SEMI JOIN mine USING (id) UNION ALL SELECT 'decision', id, artifact_type || ':' || decision FROM decisions JOIN mine ON artifact_id IN (id, 'trace-' || id) AND (artifact_type = 'proposition' OR ord % 2 = 1)"""

QUERIES = {
    "explorer_merged_groups": (explorer_merged_groups, f"WITH {_SUMMARY_SQL} SELECT * FROM summary"),
    "explorer_merge_members": (explorer_merge_members, f"WITH {_MERGED_SQL} {_MEMBERS_SQL}"),
    "explorer_sections": (explorer_sections, f"WITH {_MERGED_SQL} {_SECTIONS_SQL}"),
    "explorer_scope_sections": (explorer_scope_sections, f"WITH {_SUMMARY_SQL} SELECT bucket, bucket_label AS label, count(*) AS n_groups, sum(n_rows)::BIGINT AS n_rows FROM summary GROUP BY 1, 2"),
    "explorer_group_detail": (explorer_group_detail, f"WITH {_DETAIL_SQL}"),
}

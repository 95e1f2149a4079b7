"""Queries over candidates of source families, with the DuckDB SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C

#: Parts stand for instruments: the registry holds them all, candidates name them again in other words and with some of their keys.
_REGISTRY = """SELECT p_partkey AS entry_id, 'reg-' || lpad(CAST(p_partkey AS STRING), 7, '0') AS registry_id, p_name || ' for the ' || p_brand || ' ' || p_type AS title, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand || '–' || CAST(p_partkey AS STRING) END AS citation, CASE WHEN p_partkey % 4 = 0 THEN '3' || CAST(p_partkey AS STRING) || ' r-0' ELSE '' END AS celex,
 CASE WHEN p_partkey % 3 = 0 THEN 'https://Example.org/Part/' || CAST(p_partkey AS STRING) || '/data.xml' ELSE '' END AS url, CASE WHEN p_partkey % 5 = 0 THEN 'Other' ELSE 'legislation_gov_uk' END AS authority, 'uksi/2020/' || CAST(p_partkey AS STRING) AS authority_source_id FROM {part} WHERE p_partkey % 8 <> 7"""
_CANDIDATES = """SELECT 'cand-' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 31 = 0 THEN ' ' WHEN p_partkey % 32 = 0 THEN 'The legal framework of ' || p_name WHEN p_partkey % 2 = 0 THEN p_type || ' and ' || p_name ELSE 'A note on ' || p_name END AS title, CASE WHEN p_partkey % 6 = 0 THEN lower(p_brand) || '-' || CAST(p_partkey AS STRING) ELSE '' END AS citation,
 CASE WHEN p_partkey % 10 = 0 THEN '3' || CAST(p_partkey AS STRING) || 'R0' ELSE '' END AS celex, CASE WHEN p_partkey % 11 = 0 THEN 'https://example.org/part/' || CAST(p_partkey AS STRING) || '/' WHEN p_partkey % 11 = 1 THEN 'https://www.legislation.gov.uk/UKSI/2021/' || CAST(p_partkey % 50 AS STRING) || '/data.xml' WHEN p_partkey % 11 = 2 THEN 'https://www.legislation.gov.uk/search' ELSE '' END AS url,
 CASE WHEN p_partkey % 13 = 0 THEN '/uksi/2020/' || CAST(p_partkey AS STRING) || '/' WHEN p_partkey % 13 = 1 THEN 'eur/2019' WHEN p_partkey % 13 = 2 THEN 'asp/2022/' || CAST(p_partkey AS STRING) ELSE '' END AS candidate_source_id, CASE WHEN p_partkey % 17 = 0 THEN ' other ' ELSE '' END AS authority, CASE WHEN p_partkey % 19 = 0 THEN 'eli/x' ELSE '' END AS eli,
 CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'unknown' WHEN 1 THEN NULL ELSE 'delegated_act' END AS source_role, CASE WHEN p_partkey % 12 = 5 THEN '' ELSE 'implements_target' END AS relationship_to_target, CASE WHEN p_partkey % 5 = 0 THEN 'optional_context' ELSE 'required' END AS inclusion_status, CASE WHEN p_partkey % 29 = 0 THEN true END AS conceptual FROM {part}"""
_DECISIONS = """SELECT 'cand-' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'ignored' ELSE 'covered_by_existing' END AS decision, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE 'reg-' || lpad(CAST(p_partkey AS STRING), 7, '0') END AS existing_registry_id FROM {part} WHERE p_partkey % 14 IN (3, 4)"""
_SESSION = "SELECT 'cand-' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 37 = 1 THEN ' ' ELSE 'new-' || CAST(p_partkey AS STRING) END AS registry_id FROM {part} WHERE p_partkey % 37 < 2"
_ASKED = "SELECT p_partkey AS ord, CASE WHEN p_partkey % 41 = 0 THEN ' ' WHEN p_partkey % 43 = 0 THEN 'cand-none' ELSE ' cand-' || CAST(p_partkey AS STRING) END AS candidate_id FROM {part} WHERE p_partkey % 3 <> 1"


def _rows(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return spark.sql(query, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def duplicate_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry entry that each candidate repeats, by its keys and its title."""
    return C.duplicates(_rows(spark, sf_dir, _CANDIDATES), _rows(spark, sf_dir, _REGISTRY))


def family_candidate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each candidate."""
    return C.classify(*(_rows(spark, sf_dir, q) for q in (_CANDIDATES, _REGISTRY, _DECISIONS, _SESSION)))


def family_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each candidate that is to be registered."""
    return C.register(*(_rows(spark, sf_dir, q) for q in (_ASKED, _CANDIDATES, _REGISTRY)))


def family_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registry would hold of each candidate, and why it can't hold it yet."""
    found = C.with_reference(_rows(spark, sf_dir, _CANDIDATES))
    return found.select("id", "site_id", C.authority().alias("resolved_authority"), C.has_locator().alias("has_locator"), "reference_id", "reference_url", "jurisdiction", "reference_citation", "reason")


def profile_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instruments of the profile with the most members (the parts of a brand), in its order."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    profiles = parts.groupBy(F.col("p_brand").alias("profile_id")).agg(F.sort_array(F.collect_list("p_partkey")).alias("member_ids"))
    largest = profiles.orderBy(F.size("member_ids").desc(), "profile_id").first()
    return C.profile_members(profiles, parts.select(F.col("p_partkey").alias("instrument_id"), F.col("p_name").alias("title")), largest.profile_id)


_P = {"part": "part"}
_CELEX, _CITE = r"upper(regexp_replace({0}, '[\s/._-]+', '', 'g'))", r"trim(regexp_replace(regexp_replace(lower({0}), '[–—]', '-', 'g'), '\s+', ' ', 'g'))"
_URL = r"CASE WHEN {0} = '' THEN '' ELSE regexp_replace(regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1)), '/data\.xml$', ''), '/+$', '') END"
_STOPPED = ", ".join(f"'{w}'" for w in C.STOP)
_WORDS = rf"list_distinct(list_filter(string_split_regex(regexp_replace(lower({{0}}), '[^a-z0-9]+', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({_STOPPED})))"
_PATH = r"list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '' AND lower(s) <> 'data.xml')"
_SITE = f"coalesce(CASE WHEN contains(lower(url), 'legislation.gov.uk') AND len({_PATH}) >= 3 THEN lower(array_to_string({_PATH}, '/')) END, CASE WHEN len(list_filter(string_split(candidate_source_id, '/'), lambda s: s <> '')) >= 3 THEN lower(trim(candidate_source_id, '/')) END)"
_SERIES = ", ".join(f"'{s}'" for s in C.SERIES)
_AUTH = f"coalesce(nullif(trim(authority), ''), CASE WHEN contains(lower(url), 'legislation.gov.uk') OR (contains(candidate_source_id, '/') AND lower(split_part(candidate_source_id, '/', 1)) IN ({_SERIES})) THEN 'legislation_gov_uk' END)"
_UNKNOWN = "lower(trim(coalesce({0}, ''))) IN ('', 'unknown')"
_CAND_SQL = f"""
cand0 AS (SELECT *, {_SITE} AS site_id, {_AUTH} AS auth FROM ({_CANDIDATES.format(**_P)})), cand1 AS (SELECT *, url <> '' OR (auth IS NOT NULL AND (citation <> '' OR celex <> '' OR eli <> '')) AS loc FROM cand0),
cand AS (SELECT *, CASE WHEN trim(title) = '' THEN 'missing title' WHEN {_UNKNOWN.format("source_role")} THEN 'source_role required (not unknown)' WHEN {_UNKNOWN.format("relationship_to_target")} THEN 'relationship_to_target required (not unknown)' WHEN NOT loc THEN 'need url or authority with citation/celex/eli' WHEN site_id IS NULL THEN 'cannot auto-register (manual review needed)' ELSE '' END AS reason FROM cand1),
reg AS ({_REGISTRY.format(**_P)}),
c AS (SELECT id, trim(title) AS t, {_CELEX.format("celex")} AS x, {_CITE.format("citation")} AS k, coalesce(site_id, '') AS s, {_URL.format("url")} AS u, {_WORDS.format("title")} AS w FROM cand), r AS (SELECT entry_id, trim(title) AS t, {_CELEX.format("celex")} AS x, {_CITE.format("citation")} AS k, lower(authority_source_id) AS s, {_URL.format("url")} AS u, {_WORDS.format("title")} AS w FROM reg),
p AS (SELECT c.id, entry_id, c.x <> '' AND c.x = r.x AS ex, length(c.k) > 6 AND c.k = r.k AS ek, c.s <> '' AND c.s = r.s AS es, c.u <> '' AND c.u = r.u AS eu, CASE WHEN len(c.w) + len(r.w) > 0 THEN 2.0::DOUBLE * len(list_intersect(c.w, r.w)) / (len(c.w) + len(r.w)) ELSE 0.0::DOUBLE END AS d, length(c.t) > 14 AND length(r.t) > 14 AS lt FROM c, r),
sc AS (SELECT id, entry_id, round(d, 6) AS similarity, (CASE WHEN ex THEN 50 ELSE 0 END + CASE WHEN ek THEN 40 ELSE 0 END + CASE WHEN es THEN 60 ELSE 0 END + CASE WHEN eu THEN 45 ELSE 0 END + CASE WHEN d >= 0.72 AND lt THEN floor(d * 20 + 0.5) ELSE 0 END)::INTEGER AS score,
  array_to_string(list_filter([CASE WHEN ex THEN 'celex' END, CASE WHEN ek THEN 'citation' END, CASE WHEN es THEN 'authority_source_id' END, CASE WHEN eu THEN 'url' END, CASE WHEN d >= 0.72 AND lt THEN 'title_similarity' END], lambda x: x IS NOT NULL), '|') AS matched_by FROM p WHERE ex OR ek OR es OR eu OR (d >= 0.72 AND lt)),
dup AS (SELECT id, entry_id, score, similarity, matched_by FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, entry_id) AS nth FROM sc) WHERE nth = 1 AND ((matched_by <> 'title_similarity' AND score >= 40) OR (contains(matched_by, 'title_similarity') AND score >= 18)))"""
_CLASSIFY_SQL = f"""
WITH {_CAND_SQL}, dec AS ({_DECISIONS.format(**_P)}), ses AS (SELECT id, nullif(trim(registry_id), '') AS now FROM ({_SESSION.format(**_P)})), held AS (SELECT lower(authority_source_id) AS site_id, max(registry_id) AS held FROM reg WHERE lower(authority) = 'legislation_gov_uk' GROUP BY 1),
x AS (SELECT cand.*, coalesce(now, held) AS existing, decision, CASE WHEN decision = 'covered_by_existing' THEN nullif(trim(existing_registry_id), '') END AS cov, reg.registry_id AS tw, coalesce(conceptual, false) OR regexp_matches(cand.title, '{C.CONCEPTUAL}') AS con
  FROM cand LEFT JOIN held USING (site_id) LEFT JOIN dec ON dec.id = cand.id LEFT JOIN ses ON ses.id = cand.id LEFT JOIN dup ON dup.id = cand.id LEFT JOIN reg ON reg.entry_id = dup.entry_id),
y AS (SELECT *, CASE WHEN tw IS DISTINCT FROM cov THEN tw END AS twin, list_filter([CASE WHEN con THEN 'conceptual_grouping_only' END, CASE WHEN trim(title) = '' THEN 'missing_title' END, CASE WHEN {_UNKNOWN.format("source_role")} OR {_UNKNOWN.format("relationship_to_target")} THEN 'unknown_source_role_or_relationship' END,
  CASE WHEN NOT loc THEN 'insufficient_citation_celex_eli' WHEN auth IS NULL THEN 'ambiguous_authority_source' END, CASE WHEN url = '' AND site_id IS NULL THEN 'missing_fetchable_url' END], lambda b: b IS NOT NULL) AS blocks FROM x),
z AS (SELECT *, CASE WHEN decision = 'ignored' THEN 'ignored' WHEN existing IS NOT NULL THEN 'already_registered' WHEN con OR cov IS NOT NULL THEN 'needs_source_selection' WHEN twin IS NOT NULL THEN 'possible_duplicate' WHEN inclusion_status = 'optional_context' AND reason <> '' THEN 'context_only' WHEN reason <> '' THEN 'needs_source_selection' ELSE 'ready_to_register' END AS state FROM y)
SELECT id, state, CASE WHEN state = 'already_registered' THEN existing WHEN state = 'needs_source_selection' AND NOT con THEN cov WHEN state = 'possible_duplicate' THEN twin END AS registry_id,
  CASE WHEN state = 'possible_duplicate' THEN 'possible_duplicate_of_existing' WHEN state = 'context_only' OR (state = 'needs_source_selection' AND (con OR cov IS NULL)) THEN array_to_string(blocks, '|') ELSE '' END AS block_reasons FROM z"""
_REGISTER_SQL = f"""
WITH {_CAND_SQL}, a AS (SELECT ord, trim(candidate_id) AS candidate_id FROM ({_ASKED.format(**_P)}) WHERE trim(candidate_id) <> ''), held AS (SELECT lower(trim(authority_source_id, '/')) AS site_id, min(registry_id) AS held FROM reg WHERE lower(authority) = 'legislation_gov_uk' GROUP BY 1),
x AS (SELECT ord, candidate_id, site_id, reason, held FROM a LEFT JOIN cand ON cand.id = candidate_id LEFT JOIN held USING (site_id)), y AS (SELECT *, CASE WHEN reason = '' AND held IS NULL THEN row_number() OVER (PARTITION BY site_id, reason = '' AND held IS NULL ORDER BY ord, candidate_id) END AS nth FROM x)
SELECT ord, candidate_id, CASE WHEN reason IS NULL THEN 'error' WHEN reason <> '' THEN 'manual_review_needed' WHEN held IS NOT NULL OR nth > 1 THEN 'already_registered' ELSE 'registered' END AS outcome,
  CASE WHEN reason IS NULL THEN 'candidate_id not found for target' WHEN reason <> '' THEN reason ELSE coalesce(held, 'reg-' || trim(regexp_replace(lower('legislation_gov_uk-' || site_id), '[^a-z0-9]+', '-', 'g'), '-')) END AS detail FROM y"""
_REFERENCE_SQL = f"""
WITH {_CAND_SQL} SELECT id, site_id, auth AS resolved_authority, loc AS has_locator, 'src-' || trim(regexp_replace(site_id, '[^a-z0-9]+', '-', 'g'), '-') AS reference_id, 'https://www.legislation.gov.uk/' || site_id || '/data.xml' AS reference_url, CASE WHEN site_id IS NOT NULL THEN CASE WHEN split_part(site_id, '/', 1) IN ({_SERIES}) AND split_part(site_id, '/', 1) <> 'eur' THEN 'UK' ELSE 'EU' END END AS jurisdiction,
  CASE WHEN site_id IS NOT NULL THEN coalesce(nullif(citation, ''), nullif(celex, ''), site_id) END AS reference_citation, reason FROM cand"""
_PROFILE_SQL = """WITH m AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 1) SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::INTEGER AS place, p_partkey AS instrument_id, p_name AS title FROM part WHERE p_brand = (SELECT p_brand FROM m)"""

QUERIES = {
    "duplicate_scoring": (duplicate_scoring, f"WITH {_CAND_SQL} SELECT * FROM dup"),
    "family_candidate_states": (family_candidate_states, _CLASSIFY_SQL),
    "family_registration": (family_registration, _REGISTER_SQL),
    "family_references": (family_references, _REFERENCE_SQL),
    "profile_cases": (profile_cases, _PROFILE_SQL),
}

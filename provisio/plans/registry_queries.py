"""Queries over the registry of sources: parts as entries, orders as what is asked and refreshed; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import registry as R

_ENTRIES = """
SELECT p_partkey AS ord, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE CASE p_partkey % 7 WHEN 0 THEN 'eur' WHEN 1 THEN 'ukpga' WHEN 2 THEN 'uksi' WHEN 3 THEN 'asp' WHEN 4 THEN 'nisr' WHEN 5 THEN 'xyz' ELSE 'nia' END || '/' || CAST(2000 + p_partkey % 25 AS STRING) || '/' || CAST(100 + p_partkey % 900 AS STRING) END AS authority_source_id,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS title, p_brand AS citation, p_type AS jurisdiction, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'Office ' || CAST(p_size % 5 AS STRING) END AS authority, CASE WHEN p_partkey % 3 = 0 THEN ' https://example.org/' || CAST(p_partkey AS STRING) ELSE ' ' END AS source_url
FROM {part}
"""
_ASKED = """
SELECT o_orderkey AS query_id, CASE o_orderkey % 13
  WHEN 0 THEN ' eur/' || y || '/' || n || ' ' WHEN 1 THEN 'The EU ' || y || ' / ' || n || ' on marks' WHEN 2 THEN 'CELEX: 3' || y || 'R0' || n WHEN 3 THEN 'Regulation (EU) No ' || y || '/' || n
  WHEN 4 THEN y || '/0' || n WHEN 5 THEN 'https://www.legislation.gov.uk/id/uksi/' || y || '/' || n || '/data.xml?view=1' WHEN 6 THEN 'Animal-Health  Law of ' || y WHEN 7 THEN 'A H-L' WHEN 8 THEN 'see 3 ' || y || ' r 0' || n
  WHEN 9 THEN ' a ' WHEN 10 THEN '32011R0' || n || '; Eur / ' || y || ' / ' || n || ', regulation no 2012/' || n || ' and 32011r' || n || ' (2013/' || n || ')' WHEN 11 THEN 'ukpga/' || y || '/00' || n ELSE 'keeping of animals, 32016L0429, x/' || y || '/' || n END AS query
FROM (SELECT o_orderkey, CAST(2000 + o_orderkey % 25 AS STRING) AS y, CAST(100 + o_orderkey % 900 AS STRING) AS n FROM {orders})
"""


def _read(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet")})


def search_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifiers that each query names, in order, and that of an address."""
    return _read(spark, sf_dir, _ASKED, "orders").select("query_id", F.array_join(R.hints(F.col("query")), ",").alias("hints"), R.id_of_url(F.col("query")).alias("by_url"))


_NUM = "regexp_replace({0}, '^0+([0-9])', '\\1')"
_EUR = lambda text, pattern: f"CASE WHEN regexp_matches({text}, '{pattern}') THEN 'eur/' || regexp_extract({text}, '{pattern}', 1) || '/' || {_NUM.format(f"regexp_extract({text}, '{pattern}', 2)")} END"
_CELEX = _EUR("regexp_replace(regexp_replace(c, '(?i)^celex\\s*:\\s*', ''), '\\s+', '', 'g')", "^3(\\d{4})[Rr](\\d{2,})$")
_HINTED = f"""
asked AS ({_ASKED.format(orders="orders")}), t AS (SELECT query_id, trim(query) AS q FROM asked),
named AS (SELECT query_id, q, list_concat([{_EUR("q", "(?i)(?:^|\\s)eur\\s*/\\s*(20\\d{2})\\s*/\\s*(\\d{3,})\\b")}, {_EUR("q", "(?i)\\b(?:EUR|EU)\\s+(20\\d{2})\\s*/\\s*(\\d{3,})\\b")}],
  [{_CELEX} FOR c IN string_split_regex(translate(q, ';,', '  '), '\\s+')], [{_CELEX} FOR c IN regexp_extract_all(q, '\\b(3\\s*\\d{{4}}\\s*[Rr]\\s*\\d{{3,}})\\b', 1)],
  [{_EUR("q", "(?i)\\bregulation\\b[^0-9]{0,48}(20\\d{2})\\s*/\\s*(\\d{3,})\\b")}, {_EUR("q", "(?:^|[^/])(20\\d{2})\\s*/\\s*(\\d{3,})\\b")}]) AS ids, replace(regexp_replace(lower(q), '\\s+', ' ', 'g'), '-', ' ') AS words FROM t WHERE length(q) >= 2),
flat AS (SELECT query_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM named
  UNION ALL SELECT query_id, 'eur/2016/429', 0 FROM named WHERE words LIKE '%animal health law%' OR words LIKE '%animal health regulation%' OR words LIKE '%transmissible animal diseases%' OR words IN ('animal health', 'ahl', 'a h l')),
hints AS (SELECT query_id, id, max(i) AS place FROM flat WHERE id IS NOT NULL GROUP BY ALL),
urls AS (SELECT query_id, lower(regexp_extract(q, '^https?://[^/]*legislation[.]gov[.]uk[^/]*/(?:id/)?([A-Za-z0-9]+)/(\\d{{4}})/(\\d+)(?:/made)?(?:/data[.]xml)?/?(?:[?#].*)?$', 1)) AS series, regexp_extract(q, '/(\\d{{4}})/0*(\\d+)', 1) AS y, regexp_extract(q, '/(\\d{{4}})/0*(\\d+)', 2) AS n FROM t),
url AS (SELECT query_id, series || '/' || y || '/' || n AS id FROM urls WHERE series <> '')
"""
HINTS_SQL = f"""
WITH {_HINTED}
SELECT asked.query_id, coalesce(string_agg(h.id, ',' ORDER BY h.place DESC), '') AS hints, any_value(url.id) AS by_url FROM asked LEFT JOIN hints h USING (query_id) LEFT JOIN url USING (query_id) GROUP BY asked.query_id
"""


def source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for each query among all entries."""
    found = R.resolve(_read(spark, sf_dir, _ASKED, "orders"), _read(spark, sf_dir, _ENTRIES, "part").filter("authority_source_id != ''"), 3)
    return found.select("query_id", "rank", "authority_source_id", "title", "ord")


SEARCH_SQL = f"""
WITH {_HINTED},
e AS (SELECT authority_source_id AS id, arg_min({{'t': title}}, ord).t AS title, min(ord) AS ord FROM ({_ENTRIES.format(part="part")}) WHERE authority_source_id <> '' GROUP BY id),
whole AS (SELECT query_id, lower(regexp_extract(q, '^([A-Za-z0-9]+)/(\\d{{4}})/0*(\\d+)$', 1)) || '/' || regexp_extract(q, '/(\\d{{4}})/0*(\\d+)$', 1) || '/' || regexp_extract(q, '/(\\d{{4}})/0*(\\d+)$', 2) AS id FROM t WHERE regexp_matches(q, '^[A-Za-z0-9]+/\\d{{4}}/\\d+$')),
bare AS (SELECT query_id, s.s || '/' || regexp_extract(q, '^(\\d{{4}})/0*(\\d+)$', 1) || '/' || regexp_extract(q, '^(\\d{{4}})/0*(\\d+)$', 2) AS id, s.i FROM t, (VALUES (1, 'eur'), (2, 'ukpga'), (3, 'uksi'), (4, 'asp'), (5, 'ssi'), (6, 'wsi'), (7, 'nisr'), (8, 'nia'), (9, 'anaw')) s(i, s) WHERE regexp_matches(q, '^\\d{{4}}/\\d+$')),
found AS (SELECT query_id, id, 2 AS kind, -place AS i FROM hints JOIN e USING (id) WHERE query_id NOT IN (SELECT query_id FROM url)
  UNION ALL SELECT query_id, id, 1, 0 FROM whole JOIN e USING (id) UNION ALL SELECT query_id, id, 1, i FROM bare JOIN e USING (id) UNION ALL SELECT query_id, id, 0, 0 FROM url JOIN e USING (id)),
open AS (SELECT * FROM found WHERE kind <> 1 OR query_id NOT IN (SELECT query_id FROM found WHERE kind = 2 GROUP BY query_id HAVING count(*) >= 3)),
best AS (SELECT query_id, id, min((kind, i)) AS p FROM open GROUP BY ALL),
ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS rank FROM best)
SELECT query_id, rank, id AS authority_source_id, title, ord FROM ranked JOIN e USING (id) WHERE rank <= 3
"""
_WORDS = "Brand#1"


def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose identifier, title or citation holds the query."""
    return R.search_entries(_read(spark, sf_dir, _ENTRIES, "part"), f" {_WORDS}")


REGISTRY_SEARCH_SQL = f"""
WITH f AS (SELECT *, CASE WHEN authority_source_id = '' THEN 'row ' || ord ELSE authority_source_id END AS k FROM ({_ENTRIES.format(part="part")}) WHERE lower(coalesce(title, '')) LIKE '%{_WORDS.lower()}%' OR lower(citation) LIKE '%{_WORDS.lower()}%'),
g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord) = 1)
SELECT coalesce(title, CASE WHEN authority_source_id = '' THEN 'Untitled registry source' ELSE authority_source_id END) AS title, citation, authority_source_id, jurisdiction, coalesce(authority, 'registry') AS authority,
  CASE WHEN trim(source_url) <> '' THEN trim(source_url) WHEN authority_source_id = '' OR authority_source_id LIKE 'xyz/%' THEN '' ELSE 'https://www.legislation.gov.uk/' || authority_source_id END AS canonical_source_url, 'registry.match' AS provenance, ord FROM g
"""


def registry_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each part as a reference where every seventh authority identifier is registered already."""
    references = _read(spark, sf_dir, _ENTRIES, "part").withColumn("registry_id", F.when(F.col("ord") % 17 == 0, F.concat(F.lit("own-"), F.col("ord") % 5)))
    known = references.filter("ord % 7 = 0").select(F.concat(F.lit("reg-"), R.slug(F.concat_ws("-", F.coalesce("authority", F.lit("case_file")), "authority_source_id"))).alias("registry_id"))
    return R.register(known, references).select("ord", "registry_id", "status")


_REG_ID = "'reg-' || trim(regexp_replace(lower(coalesce(authority, 'case_file') || '-' || authority_source_id), '[^a-z0-9]+', '-', 'g'), '-')"
REGISTER_SQL = f"""
WITH r AS (SELECT ord, {_REG_ID} AS made, CASE WHEN authority_source_id = '' THEN NULL WHEN ord % 17 = 0 THEN 'own-' || (ord % 5) ELSE {_REG_ID} END AS registry_id FROM ({_ENTRIES.format(part="part")}))
SELECT ord, registry_id, CASE WHEN registry_id IS NULL THEN 'no_identifier' WHEN registry_id IN (SELECT made FROM r WHERE ord % 7 = 0) OR row_number() OVER (PARTITION BY registry_id ORDER BY ord) > 1 THEN 'exists' ELSE 'registered' END AS status FROM r
"""


def registry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current state of some customers as sources, refreshed by their orders, in the order asked for."""
    history = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("reg-"), "o_custkey").alias("registry_id"), F.col("o_orderdate").alias("refreshed_at"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("decision"))
    states = R.current_states(history)
    return R.case_sources(spark, states, [f"reg-{i}" for i in (40, 7, 1, 7, 100, 2, 13, 0)]).select("pos", "registry_id", "seq", "decision", "refreshes")


STATES_SQL = """
SELECT w.pos, w.id AS registry_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS seq, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS decision, count(*) AS refreshes
FROM (VALUES (0, 'reg-40'), (1, 'reg-7'), (2, 'reg-1'), (3, 'reg-7'), (4, 'reg-100'), (5, 'reg-2'), (6, 'reg-13'), (7, 'reg-0')) w(pos, id) JOIN orders ON w.id = 'reg-' || o_custkey GROUP BY w.pos, w.id
"""

QUERIES = {
    "search_hints": (search_hints, HINTS_SQL),
    "source_search": (source_search, SEARCH_SQL),
    "registry_search": (registry_search, REGISTRY_SEARCH_SQL),
    "registry_register": (registry_register, REGISTER_SQL),
    "registry_states": (registry_states, STATES_SQL),
}

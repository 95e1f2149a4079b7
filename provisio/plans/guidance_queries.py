"""The query over guidance sections, with the DuckDB SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guidance as G
from .fixture import SENTENCES, _pick

_SECTIONS = f"""SELECT 'https://guide/' || CAST(user_id AS STRING) AS source_url, event_id AS ord, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'Section ' || CAST(event_id % 9 AS STRING) END AS locator,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE {_pick("event_id * 5 % 997", SENTENCES)} || chr(10) || '  ' || chr(10) || 'You need to keep a passport, if asked. Note this! ' || event_type || ' is not required. Ensure that it is so' END AS text FROM {{events}} WHERE event_type <> 'view'"""


def guidance_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five normative sentences of each guidance page."""
    found = G.guidance_propositions(spark.sql(_SECTIONS, events=spark.read.parquet(f"{sf_dir}/events.parquet")))
    return found.select("source_url", "index", "id", "section_locator", "proposition_text", F.array_join("required_documents", "|").alias("required_documents"))


GUIDANCE_SQL = rf"""
WITH s AS ({_SECTIONS.format(events="events")}), l AS (SELECT source_url, ord, coalesce(locator, '') AS section_locator, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM s WHERE text IS NOT NULL),
p AS (SELECT * EXCLUDE (line), string_split(regexp_replace(trim(line), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM l), q AS (SELECT source_url, ord, section_locator, i, unnest(parts) AS c, generate_subscripts(parts, 1) AS j FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY ord, i, j) AS index FROM q WHERE {" OR ".join(f"contains(lower(c), '{w}')" for w in ("must", "shall", "required", "prohibited", "you need to", "ensure"))})
SELECT source_url, index::INTEGER AS index, 'guidance-' || coalesce(nullif(trim(regexp_replace(lower(section_locator), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') || '-' || left(sha256(section_locator || ':' || index), 8) AS id, section_locator, c AS proposition_text,
 array_to_string(list_filter([{", ".join(f"CASE WHEN contains(lower(c), '{w}') THEN '{w}' END" for w in ("health certificate", "passport", "certificate", "licence", "permit", "document", "notification"))}], lambda x: x IS NOT NULL), '|') AS required_documents FROM n WHERE index <= 5
"""

QUERIES = {"guidance_propositions": (guidance_propositions, GUIDANCE_SQL)}

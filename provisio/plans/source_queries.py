"""Queries over sources: ingestion of customers as raw sources, the snapshot cache, legislation XML; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ingest as I

_RAW = """
SELECT c_custkey - 1 AS ord, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Source ' || c_name END AS id, c_name AS title, c_mktsegment AS jurisdiction, 'C/' || CAST(c_nationkey AS STRING) AS citation, 'regulation' AS kind,
       'Article 1 applies to ' || c_mktsegment AS text, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'v' || CAST(c_custkey % 5 AS STRING) END AS version_id,
       CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'article:' || CAST(c_custkey AS STRING) WHEN 2 THEN 'annex:I' ELSE 'part:2' END AS fragment_locator, ' ' AS provenance, CAST(NULL AS STRING) AS source_url
FROM {customer}
"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RAW, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def ingest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of all ingested sources with their ids, types and hashes."""
    made = I.ingest(_raw(spark, sf_dir))
    return made["fragments"].join(made["sources"].select(F.col("id").alias("source_record_id"), "version_id", "provenance"), "source_record_id").drop("fragment_text")


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
INGEST_SQL = f"""
WITH raw AS ({_RAW.format(customer="customer")}),
r AS (SELECT *, CASE WHEN id = '' THEN 'src-' || {_SLUG.format("jurisdiction")} || '-' || CASE WHEN ord + 1 < 1000 THEN lpad(CAST(ord + 1 AS VARCHAR), 3, '0') ELSE CAST(ord + 1 AS VARCHAR) END ELSE id END AS sid, coalesce(version_id, 'v1') AS v FROM raw)
SELECT 'frag-' || {_SLUG.format("r.sid")} || '-001' AS id, r.sid AS source_record_id, 'snap-' || {_SLUG.format("r.sid")} || '-' || r.v AS source_snapshot_id, CASE WHEN r.fragment_locator = '' THEN 'document:full' ELSE r.fragment_locator END AS locator,
  CASE WHEN r.fragment_locator = '' THEN 'document' WHEN starts_with(r.fragment_locator, 'article:') THEN 'article' WHEN starts_with(r.fragment_locator, 'annex:') THEN 'annex' ELSE 'unknown' END AS fragment_type, sha256(r.text) AS text_hash, s.v AS version_id, 'demo.case_file' AS provenance
FROM r JOIN r s ON r.sid = s.sid
"""


def snapshot_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's request against a cache of every third of them, twice stored."""
    rows = _raw(spark, sf_dir).withColumn("key", I.cache_key(F.lit("Demo"), F.col("title"), F.col("jurisdiction"), F.col("citation"), F.coalesce("version_id", F.lit("")), F.sha2(F.col("text").cast("binary"), 256)))
    cached = rows.filter("ord % 3 = 0").select("key", F.explode(F.array(F.lit("2024-01-01"), F.lit("2024-02-01"))).alias("stored_at"))
    return I.fetch_status(rows.select("title", "key"), cached)


CACHE_SQL = f"""
WITH raw AS ({_RAW.format(customer="customer")})
SELECT title, sha256('demo|' || lower(title) || '|' || lower(jurisdiction) || '|' || lower(citation) || '|' || coalesce(version_id, '') || '|' || sha256(text)) AS key, CASE WHEN ord % 3 = 0 THEN '2024-02-01' END AS stored_at, CASE WHEN ord % 3 = 0 THEN 'cache_hit' ELSE 'success' END AS status FROM raw
"""
_XML = "'<Act><Metadata><P id=\"m\">meta</P></Metadata><Body><P1 id=\"section-' || CAST(p_partkey AS STRING) || '\">Section ' || CAST(p_partkey AS STRING) || ' The keeper must <Emph>keep</Emph> it.</P1><P1 id=\"s-x\">Explanatory notes</P1><P2 id=\"s-y\">Whereas it may be so</P2></Body></Act>'"


def legislation_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions of an instrument for each part: locators, inferred places, operative or not."""
    docs = spark.sql(f"SELECT p_partkey AS id, {_XML} AS xml FROM {{part}}", part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    found = I.legislation_provisions(docs, "id", "xml")
    return found.select("id", "ord", "locator", I.locator_of(F.col("text")).alias("place"), I.is_operative_text(F.col("text"), F.col("locator")).alias("operative"))


XML_SQL = """
SELECT p_partkey AS id, 0 AS ord, 'xml:section-' || p_partkey AS locator, 'section:' || p_partkey AS place, true AS operative FROM part
UNION ALL SELECT p_partkey, 2, 'xml:s-y', NULL, false FROM part
"""

QUERIES = {"ingest_sources": (ingest_sources, INGEST_SQL), "snapshot_cache": (snapshot_cache, CACHE_SQL), "legislation_xml": (legislation_xml, XML_SQL)}

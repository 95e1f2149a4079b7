"""Extraction by rules over sources made of customers, each with three fragments; tested against plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import extraction as X

LIMIT = 4
_FRAGMENTS = """
SELECT 'Src ' || CAST(c_custkey AS STRING) AS source_record_id, ord, locator, CASE
  WHEN c_custkey % 6 = 5 THEN CASE ord WHEN 0 THEN '' ELSE NULL END
  WHEN ord = 0 THEN 'Whereas the ' || c_mktsegment || ' may grow; It is so.'
  WHEN ord = 1 AND c_custkey % 6 = 1 THEN '1. The keeper must:\n(a) keep a record;\n(b) report to the authority.'
  WHEN ord = 1 AND c_custkey % 6 = 0 THEN '1. The keeper must:\n(a) keep a record of:\n(i) ' || c_name || ';\n(ii) births;\n(iii) deaths;\n(b) report to the authority;\n(c) hold a licence.'
  WHEN ord = 1 THEN 'Marks are set out here. ' || CASE WHEN c_custkey % 6 < 4 THEN 'The operator shall, after Article 4, inform ' || c_name || '. An importer must show a certificate if asked.' ELSE 'Nothing follows.' END
  ELSE 'The keeper must report to the authority. The person is required to wait before ' || c_mktsegment || ' opens.' END AS fragment_text
FROM {customer}, (VALUES (0, 'recital:1'), (1, 'article:2'), (2, 'note:x')) f(ord, locator)
WHERE NOT (c_custkey % 6 = 4 AND ord = 2)
"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_FRAGMENTS, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propositions of every source, four at most."""
    pieces = fragments(spark, sf_dir)
    sources = spark.sql("SELECT source_record_id, CASE WHEN hash(source_record_id) % 2 = 0 THEN 'document:full' ELSE 'article:2' END AS locator, array_join(transform(array_sort(collect_list(struct(ord, fragment_text))), x -> x.fragment_text), '\n') AS text FROM {pieces} GROUP BY source_record_id", pieces=pieces)
    return X.extract_by_rules(sources, pieces, LIMIT)


QUERIES = {"rule_extraction": (rule_extraction, None)}

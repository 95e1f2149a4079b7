"""Queries over whole datasets, with the DuckDB SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets as D
from ..operators import propositions as P
from .fixture import LAW_SQL, law
from .text_queries import FIELDS_SQL

_PROPS = "SELECT 'prop-' || CAST(event_id AS STRING) AS id, ' src-' || CAST(user_id % 40 AS STRING) AS source_record_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'frag-' || CAST(event_id % 9 AS STRING) END AS source_fragment_id, event_type AS said FROM {events}"
_CHUNKS = "SELECT CASE WHEN event_id % 97 = 0 THEN '' ELSE 'src-' || CAST(user_id % 40 AS STRING) END AS source_record_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'frag-' || CAST(event_id % 9 AS STRING) END AS source_fragment_id FROM {events} WHERE event_id % 83 = 0"
_RERUN = "SELECT 'new-' || CAST(event_id AS STRING) AS id, 'src-' || CAST(user_id % 40 AS STRING) AS source_record_id, 'frag-' || CAST(event_id % 9 AS STRING) AS source_fragment_id FROM {events} WHERE event_id % 83 = 0"
_SOURCES = "SELECT DISTINCT 'run-' || CAST(user_id % 11 AS STRING) AS run_id, CASE WHEN user_id % 13 = 0 THEN ' ' ELSE 'src-' || CAST(user_id AS STRING) END AS id, CASE WHEN user_id % 11 = 0 THEN 'EU' WHEN user_id % 11 = 1 THEN ' gb ' WHEN user_id % 11 = 2 THEN 'France' WHEN user_id % 11 = 3 THEN '' WHEN user_id % 2 = 0 THEN 'European Union' ELSE 'Scotland' END AS jurisdiction FROM {events}"
_RUNS = "SELECT DISTINCT 'run-' || CAST(user_id % 12 AS STRING) AS run_id, CASE WHEN user_id % 12 = 5 THEN ' ' WHEN user_id % 12 = 6 THEN 'fail' ELSE 'pass' END AS status FROM {events}"


def _rows(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return spark.sql(query, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def repaired_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propositions after the jobs of failed chunks have run again."""
    props, chunks, rerun = (_rows(spark, sf_dir, q) for q in (_PROPS, _CHUNKS, _RERUN))
    return D.repaired(props, D.repair_targets(chunks), rerun)


def dataset_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of each run's dataset."""
    return D.dataset_metadata(_rows(spark, sf_dir, _RUNS), _rows(spark, sf_dir, _SOURCES))


def case_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a case for these sources would ask for."""
    traces = _rows(spark, sf_dir, "SELECT event_id AS ord, CASE WHEN event_id % 7 < 3 THEN array(' ', '') WHEN event_id % 7 = 3 THEN NULL ELSE array(' s' || CAST(event_id % 5 AS STRING), '', 'x') END AS focus_scopes FROM {events}")
    return D.case_inputs(_rows(spark, sf_dir, _SOURCES), traces)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs' propositions: those of even events under EU law, those of odd events under UK law."""
    rows = P.with_fields(law(spark, sf_dir))
    return rows.filter("ord % 2 = 0").withColumn("jurisdiction", F.lit("European Union")), rows.filter("ord % 2 = 1").withColumn("jurisdiction", F.lit("gb"))


def dataset_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two runs laid together, by source."""
    return D.compare_datasets(*_sides(spark, sf_dir), "EU", "UK", ["source_record_id", "article_reference"], ["ord"])


def dataset_comparison_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of that comparison."""
    known = dataset_metadata(spark, sf_dir)
    return D.comparison_record("cmp-1", known.filter("run_id = 'run-0'"), known.filter("run_id = 'run-1'"), dataset_comparison(spark, sf_dir))


_E = {"events": "events"}
_REPAIRED_SQL = f"""
WITH p AS ({_PROPS.format(**_E)}), t AS (SELECT DISTINCT trim(source_record_id) AS s, trim(source_fragment_id) AS f FROM ({_CHUNKS.format(**_E)}) WHERE trim(source_record_id) <> '')
SELECT id, source_record_id, source_fragment_id, said FROM p WHERE (trim(source_record_id), coalesce(trim(source_fragment_id), '')) NOT IN (SELECT s, f FROM t) UNION ALL SELECT id, source_record_id, source_fragment_id, NULL FROM ({_RERUN.format(**_E)})"""
_LABEL = "CASE WHEN upper(trim(jurisdiction)) IN ('EU', 'EUROPEAN UNION') THEN 'EU' WHEN upper(trim(jurisdiction)) IN ('UK', 'GB') THEN 'UK' WHEN trim(jurisdiction) = '' THEN NULL ELSE upper(trim(jurisdiction)) END"
_METADATA_SQL = f"""
meta AS (SELECT 'pd:' || r.run_id AS dataset_id, r.run_id, CASE WHEN n > 1 THEN 'mixed' WHEN n = 1 AND lo IN ('EU', 'UK') THEN lo ELSE 'unknown' END AS jurisdiction_scope, coalesce(ids, []) AS source_ids, coalesce(nullif(trim(status), ''), 'unknown') AS quality_status
  FROM ({_RUNS.format(**_E)}) r LEFT JOIN (SELECT run_id, count(DISTINCT {_LABEL}) AS n, min({_LABEL}) AS lo, list(DISTINCT id ORDER BY id) FILTER (trim(id) <> '') AS ids FROM ({_SOURCES.format(**_E)}) GROUP BY 1) s USING (run_id))"""
_INPUTS_SQL = f"""
WITH j AS (SELECT DISTINCT trim(jurisdiction) AS j FROM ({_SOURCES.format(**_E)}) WHERE trim(jurisdiction) <> '' ORDER BY 1 LIMIT 2), l AS (SELECT list(j ORDER BY j) AS js FROM j),
f AS (SELECT ['s' || CAST(event_id % 5 AS VARCHAR), 'x'] AS focus_scopes FROM events WHERE event_id % 7 > 3 ORDER BY event_id LIMIT 1)
SELECT CASE WHEN len(js) = 2 THEN js[1] END AS jurisdiction_a, CASE WHEN len(js) = 2 THEN js[2] END AS jurisdiction_b, focus_scopes FROM l, f"""
_KEYED = "PARTITION BY source_record_id, article_reference"
_COMPARED_SQL = f"""
{LAW_SQL},{FIELDS_SQL}, a AS (SELECT *, row_number() OVER ({_KEYED} ORDER BY ord) AS nth FROM fields WHERE ord % 2 = 0), b AS (SELECT *, row_number() OVER ({_KEYED} ORDER BY ord) AS nth, count(*) OVER ({_KEYED}) AS last FROM fields WHERE ord % 2 = 1),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, a.authority AS au_a, b.authority AS au_b, a.authority IS DISTINCT FROM b.authority AS au,
  CASE WHEN trim(a.proposition_text) = trim(b.proposition_text) THEN 'none' WHEN a.authority IS DISTINCT FROM b.authority AND a.action = b.action THEN 'institutional' WHEN list_sort(list_distinct(a.required_documents)) <> list_sort(list_distinct(b.required_documents)) THEN 'annex_model_certificate'
    WHEN a.conditions <> b.conditions THEN 'procedural' WHEN a.legal_subject <> b.legal_subject THEN 'definitional' WHEN a.action <> b.action THEN 'textual' ELSE 'structural' END AS divergence_type
  FROM a JOIN b USING (source_record_id, article_reference) WHERE b.nth = least(a.nth, b.last)),
found AS (SELECT 'finding-' || id_a || '-' || id_b AS finding_id, id_a, id_b, divergence_type, CASE WHEN divergence_type = 'none' OR au THEN 'high' ELSE 'medium' END AS confidence,
  CASE divergence_type WHEN 'institutional' THEN 'The propositions preserve a similar action, but the decision-maker differs: ' || coalesce(au_a, 'unspecified') || ' vs ' || coalesce(au_b, 'unspecified') || '.' {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.RATIONALES.items())} END AS rationale FROM pairs)"""
_RECORD_SQL = f"WITH {_METADATA_SQL},{_COMPARED_SQL} SELECT 'cmp-1' AS comparison_run_id, 'pd:run-0' AS left_dataset_id, 'run-0' AS left_run_id, 'pd:run-1' AS right_dataset_id, 'run-1' AS right_run_id, string_agg(divergence_type || '=' || n, '|' ORDER BY divergence_type || '=' || n) AS findings_by_type, sum(n)::BIGINT AS findings FROM (SELECT divergence_type, count(*) AS n FROM found GROUP BY 1)"

QUERIES = {
    "repaired_propositions": (repaired_propositions, _REPAIRED_SQL),
    "dataset_metadata": (dataset_metadata, f"WITH {_METADATA_SQL} SELECT * FROM meta"),
    "case_inputs": (case_inputs, _INPUTS_SQL),
    "dataset_comparison": (dataset_comparison, f"WITH {_COMPARED_SQL} SELECT * FROM found"),
    "dataset_comparison_run": (dataset_comparison_run, _RECORD_SQL),
}

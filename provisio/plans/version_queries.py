"""Queries over histories of snapshots and versions, with the DuckDB SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions as V

_SNAPSHOT = """'src-' || CAST(user_id % 40 AS STRING) AS source_record_id, CASE WHEN event_id % 29 = 0 THEN '' ELSE 'snap-' || CAST(user_id % 40 AS STRING) || '-' || CAST(event_id % 7 AS STRING) END AS id, 'v' || CAST(event_id % 7 AS STRING) AS version_id,
 'hash-' || CAST(user_id % 40 AS STRING) || '-' || CAST(event_id % 7 % 5 AS STRING) AS content_hash, CASE WHEN event_id % 7 = 6 THEN 'not a time' ELSE '2026-0' || CAST(1 + event_id % 7 % 3 AS STRING) || '-11T0' || CAST(event_id % 7 AS STRING) || ':00:00' END AS retrieved_at,
 CASE WHEN event_id % 7 = 2 THEN NULL ELSE '2026-01-0' || CAST(1 + event_id % 7 AS STRING) END AS as_of_date, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'text of ' || CAST(event_id % 7 % 5 AS STRING) END AS authoritative_text,
 'document:full' AS authoritative_locator, CASE WHEN event_id % 7 = 4 THEN '' ELSE 'case' END AS provenance"""
_RUNS = f"SELECT 'run-' || CAST(event_id % 5 AS STRING) AS run_id, {_SNAPSHOT} FROM {{events}} WHERE event_id % 2 = 0"
_CURRENT = f"SELECT 'reg-' || CAST(user_id % 40 AS STRING) AS registry_id, {_SNAPSHOT} FROM {{events}} WHERE event_id % 11 = 1"
_REFRESHES = """SELECT 'reg-' || CAST(user_id % 40 AS STRING) AS registry_id, 'src-' || CAST(user_id % 40 AS STRING) AS source_record_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'snap-' || CAST(user_id % 40 AS STRING) || '-' || CAST(event_id % 7 AS STRING) WHEN 1 THEN 'snap-gone' ELSE '' END AS source_snapshot_id,
 CASE WHEN event_id % 4 = 3 THEN '' ELSE 'hash-' || CAST(user_id % 40 AS STRING) || '-' || CAST(event_id % 9 AS STRING) END AS content_hash, CASE WHEN event_id % 8 = 0 THEN 'v' || CAST(event_id % 7 AS STRING) ELSE NULL END AS version_id, '2026-04-0' || CAST(1 + event_id % 8 AS STRING) || 'T00:00:00' AS refreshed_at, CAST(event_id AS INT) AS position
 FROM {events} WHERE event_id % 17 = 3"""
#: Versions of propositions, and of findings that rest on several snapshots.
_VERSIONS = """SELECT 'prop-' || CAST(user_id AS STRING) AS proposition_key, 'version-' || CAST(event_id AS STRING) AS version_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'snap-' || CAST(event_id % 6 AS STRING) END AS source_snapshot_id,
 CASE WHEN event_id % 19 = 0 THEN '' ELSE 'run-' || CAST(event_id % 5 AS STRING) END AS observed_in_run_id, CAST(event_id % 3 AS STRING) AS observed_at, event_type AS said FROM {events}"""
_FINDINGS = """SELECT 'finding-' || CAST(user_id % 97 AS STRING) AS finding_id, 'obs-' || CAST(event_id AS STRING) AS observation_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN {empty} WHEN event_id % 10 = 2 THEN {odd} ELSE {pair} END AS source_snapshot_ids,
 'run-' || CAST(event_id % 4 AS STRING) AS observed_in_run_id, CAST(event_id % 3 AS STRING) AS observed_at FROM {events}"""
_SPARK_ARRAYS = {"empty": "CAST(array() AS array<string>)", "odd": "array('', 'snap-1')", "pair": "array('snap-' || CAST(event_id % 3 AS STRING), 'snap-' || CAST(3 + event_id % 4 AS STRING))"}
_DUCK_ARRAYS = {"empty": "[]::VARCHAR[]", "odd": "['', 'snap-1']", "pair": "['snap-' || CAST(event_id % 3 AS STRING), 'snap-' || CAST(3 + event_id % 4 AS STRING)]"}


def _rows(spark: SparkSession, sf_dir: str, query: str, **more: str) -> DataFrame:
    return spark.sql(query.replace("{events}", "{{events}}").format(**more) if more else query, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots over runs, current states and recorded refreshes, each event once with its origins."""
    found = V.snapshot_history(*(_rows(spark, sf_dir, q) for q in (_RUNS, _CURRENT, _REFRESHES)))
    origins = F.array_join(F.transform("origins", lambda o: F.concat_ws("/", o["kind"], o["name"], o["at"])), "|")
    return found.select("source_record_id", "event_id", *V.FIELDS, origins.alias("origins"), "position", "change", F.array_join("changed_fields", "|").alias("changed_fields"))


def _as_text(found: DataFrame) -> DataFrame:
    return found.withColumn("groups", F.to_json("groups"))


def versions_by_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each proposition nested by snapshot; the nested value as JSON."""
    return _as_text(V.by_snapshot(_rows(spark, sf_dir, _VERSIONS), ["proposition_key"], ["observed_at", "version_id"], ["version_id", "observed_in_run_id", "said"]))


def versions_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each proposition nested by run; the nested value as JSON."""
    return _as_text(V.by_run(_rows(spark, sf_dir, _VERSIONS), ["proposition_key"], ["observed_at", "version_id"], ["version_id", "said"]))


def divergence_versions_by_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of each finding nested by each of the snapshots they rest on; the nested value as JSON."""
    return _as_text(V.by_snapshot(_rows(spark, sf_dir, _FINDINGS, **_SPARK_ARRAYS), ["finding_id"], ["observed_at", "observation_id"], ["observation_id", "observed_in_run_id"], "source_snapshot_ids"))


def divergence_versions_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of each finding nested by run; the nested value as JSON."""
    return _as_text(V.by_run(_rows(spark, sf_dir, _FINDINGS, **_SPARK_ARRAYS), ["finding_id"], ["observed_at", "observation_id"], ["observation_id"]))


_E = {"events": "events"}
_COLUMNS = "id, version_id, content_hash, retrieved_at, as_of_date, authoritative_text, authoritative_locator, provenance"
_HISTORY_SQL = f"""
WITH runs AS ({_RUNS.format(**_E)}), cur AS ({_CURRENT.format(**_E)}), refr AS ({_REFRESHES.format(**_E)}),
known AS (SELECT source_record_id, {_COLUMNS}, {{'r': 0, 'n': run_id, 'p': 0}} AS seq, 'run_snapshot/' || run_id || '/' AS origin FROM runs UNION ALL SELECT source_record_id, {_COLUMNS}, {{'r': 1, 'n': registry_id, 'p': 0}}, 'registry_current_state/' || registry_id || '/' FROM cur),
held AS (SELECT *, {{'id': id, 'v': version_id, 'h': content_hash, 'r': retrieved_at, 'a': as_of_date, 't': authoritative_text, 'l': authoritative_locator, 'p': provenance}} AS s FROM known),
ids AS (SELECT source_record_id, id AS k, max({{'q': seq, 's': s}}).s AS s FROM held WHERE id <> '' GROUP BY 1, 2), hashes AS (SELECT source_record_id, content_hash AS k, max({{'q': seq, 's': s}}).s AS s FROM held WHERE content_hash <> '' GROUP BY 1, 2),
met AS (SELECT r.*, coalesce(i.s, h.s) AS s FROM refr r LEFT JOIN ids i ON i.source_record_id = r.source_record_id AND i.k = r.source_snapshot_id LEFT JOIN hashes h ON h.source_record_id = r.source_record_id AND h.k = r.content_hash),
past AS (SELECT source_record_id, coalesce(nullif(source_snapshot_id, ''), s.id, '') AS id, coalesce(version_id, nullif(s.v, ''), 'unknown') AS version_id, coalesce(nullif(content_hash, ''), s.h, '') AS content_hash, coalesce(nullif(s.r, ''), refreshed_at) AS retrieved_at, s.a AS as_of_date, coalesce(s.t, '') AS authoritative_text,
  coalesce(s.l, 'document:full') AS authoritative_locator, coalesce(nullif(s.p, ''), 'registry.refresh_history') AS provenance, {{'r': 1, 'n': registry_id, 'p': position + 1}} AS seq, 'registry_refresh/' || registry_id || '/' || refreshed_at AS origin FROM met),
every AS (SELECT *, 'snapshot-event::' || source_record_id || '::' || version_id || '::' || content_hash || '::' || retrieved_at AS event_id FROM (SELECT * FROM known UNION ALL SELECT * FROM past)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_record_id, event_id ORDER BY authoritative_text = '', seq, id) AS nth FROM every) WHERE nth = 1),
orig AS (SELECT source_record_id, event_id, string_agg(origin, '|' ORDER BY seq, origin) AS origins FROM (SELECT source_record_id, event_id, origin, min(seq) AS seq FROM every GROUP BY 1, 2, 3) GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER w - 1 AS position, lag({{'x': authoritative_text}}) OVER w AS pt, lag({{'x': version_id}}) OVER w AS pv, lag({{'x': content_hash}}) OVER w AS ph, lag({{'x': as_of_date}}) OVER w AS pa, lag({{'x': provenance}}) OVER w AS pp
  FROM best JOIN orig USING (source_record_id, event_id) WINDOW w AS (PARTITION BY source_record_id ORDER BY coalesce(TRY_CAST(retrieved_at AS TIMESTAMP), TIMESTAMP '0001-01-01'), coalesce(as_of_date, ''), id, event_id)),
c AS (SELECT *, pt IS NULL AS first, pt.x IS DISTINCT FROM authoritative_text AS nt, list_filter([CASE WHEN pv.x IS DISTINCT FROM version_id THEN 'version_id' END, CASE WHEN ph.x IS DISTINCT FROM content_hash THEN 'content_hash' END, CASE WHEN pa.x IS DISTINCT FROM as_of_date THEN 'as_of_date' END, CASE WHEN pp.x IS DISTINCT FROM provenance THEN 'provenance' END], lambda x: x IS NOT NULL) AS cf FROM t)
SELECT source_record_id, event_id, {_COLUMNS}, origins, position::INTEGER AS position, CASE WHEN first THEN 'initial' WHEN nt AND len(cf) > 0 THEN 'text_and_metadata' WHEN nt THEN 'text_only' WHEN len(cf) > 0 THEN 'metadata_only' ELSE 'no_change' END AS change, CASE WHEN first THEN '' ELSE array_to_string(cf, '|') END AS changed_fields FROM c
"""


def _nested_sql(rows: str, key: str, by: str, name: str, unknown: str, order: str, version: str) -> str:
    return f"""
WITH v AS ({rows}), r AS (SELECT *, coalesce(nullif({by}, ''), '{unknown}') AS k FROM v),
i AS (SELECT {key}, k, list({version} ORDER BY {order}) AS vs FROM r GROUP BY 1, 2)
SELECT {key}, to_json(list({{'{name}': k, 'observed_version_count': len(vs), 'observed_versions': vs}} ORDER BY k))::VARCHAR AS groups FROM i GROUP BY 1"""


_DUCK_VERSIONS, _DUCK_FINDINGS = _VERSIONS.format(**_E), _FINDINGS.format(**_E, **_DUCK_ARRAYS)
_EXPLODED = f"SELECT * EXCLUDE (source_snapshot_ids), unnest(CASE WHEN len(source_snapshot_ids) > 0 THEN source_snapshot_ids ELSE [''] END) AS snapshot FROM ({_DUCK_FINDINGS})"
QUERIES = {
    "snapshot_history": (snapshot_history, _HISTORY_SQL),
    "versions_by_snapshot": (versions_by_snapshot, _nested_sql(_DUCK_VERSIONS, "proposition_key", "source_snapshot_id", "source_snapshot_id", "snapshot-unknown", "observed_at, version_id", "{'version_id': version_id, 'observed_in_run_id': observed_in_run_id, 'said': said}")),
    "versions_by_run": (versions_by_run, _nested_sql(_DUCK_VERSIONS, "proposition_key", "observed_in_run_id", "observed_in_run_id", "run-unknown", "observed_at, version_id", "{'version_id': version_id, 'said': said}")),
    "divergence_versions_by_snapshot": (divergence_versions_by_snapshot, _nested_sql(_EXPLODED, "finding_id", "snapshot", "source_snapshot_id", "snapshot-unknown", "observed_at, observation_id", "{'observation_id': observation_id, 'observed_in_run_id': observed_in_run_id}")),
    "divergence_versions_by_run": (divergence_versions_by_run, _nested_sql(_DUCK_FINDINGS, "finding_id", "observed_in_run_id", "observed_in_run_id", "run-unknown", "observed_at, observation_id", "{'observation_id': observation_id}")),
}

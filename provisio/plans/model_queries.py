"""Queries over model rows and overrides, with the DuckDB SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model_rows as M
from ..operators import overrides as O
from .fixture import SENTENCES, _pick

#: What a model says of each of 400 sources: items made of events, in their order; every seventh source wraps them in an object.
_ITEMS = f"""SELECT 'src ' || CAST(event_id % 400 AS STRING) AS source_id, event_id AS ord, event_id % 53 = 0 AS odd, CASE WHEN event_id % 31 = 0 THEN ' ' ELSE {_pick("(event_id - event_id % 400) / 400 % 5", SENTENCES[:5])} END AS proposition_text,
 CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'never said' ELSE upper({_pick("(event_id - event_id % 400) / 400 % 5", [s[4:40] for s in SENTENCES[:5]])}) END AS evidence_text, CASE WHEN event_id % 22 = 0 THEN 'no words for it' ELSE '' END AS reason, CASE WHEN event_id % 3 = 0 THEN ' Article:' || CAST(event_id % 4 AS STRING) || ' ' ELSE '' END AS source_locator,
 CASE WHEN event_id % 5 = 0 THEN 'Label' ELSE '' END AS display_label, CASE WHEN event_id % 4 = 0 THEN 'someone' ELSE ' ' END AS subject, CASE WHEN event_id % 6 = 0 THEN 'acts' END AS rule, CASE WHEN event_id % 9 = 0 THEN 'thing' END AS object, CASE WHEN event_id % 10 = 0 THEN 'in 2027' END AS temporal_condition,
 CASE WHEN event_id % 17 = 0 THEN 'strange' WHEN event_id % 17 = 1 THEN 'core' END AS provision_type, CASE WHEN event_id % 19 = 0 THEN 'half' WHEN event_id % 19 = 1 THEN 'complete' END AS completeness_status FROM {{events}}"""
_SOURCE_TEXT = "  ".join(SENTENCES[:4])
_SOURCES = f"SELECT 'src ' || CAST(event_id % 400 AS STRING) AS source_id, CASE WHEN event_id % 400 % 10 = 9 THEN NULL ELSE '{_SOURCE_TEXT.replace(chr(39), chr(39) * 2)}' END AS source_text, 'EU' AS jurisdiction, CASE WHEN event_id % 400 % 2 = 0 THEN 'document:full' ELSE 'section:12' END AS authoritative_locator, 'snap' AS current_snapshot_id FROM {{events}} GROUP BY event_id % 400"
LIMIT = 9


def _rows(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return spark.sql(query, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made, sources = _rows(spark, sf_dir, _ITEMS), _rows(spark, sf_dir, _SOURCES)
    fields = [c for c in made.columns if c not in ("source_id", "ord", "odd")]
    item = F.when(F.col("odd"), F.lit("7")).otherwise(F.to_json(F.struct(*fields, F.array(F.lit("if so"), F.lit(" ")).alias("conditions"), F.array(F.lit(" but not ")).alias("exceptions"))))
    answers = made.groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"]), ",").alias("list"))
    wrapped = F.concat(F.lit('{"propositions":['), "list", F.lit("]}"))
    seventh = F.substring_index("source_id", " ", -1).cast("int") % 7 == 0
    outputs = answers.select("source_id", F.when(seventh, wrapped).otherwise(F.concat(F.lit("["), "list", F.lit("]"))).alias("output"))
    return M.checked(M.items(outputs, objects_only=False), sources.select("source_id", "source_text"), LIMIT), sources


def model_row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a model's answers with why they are refused."""
    return _checked(spark, sf_dir)[0].select("source_id", "row_index", "reason_code", "failure_reason", "strategy", "accepted_index")


def model_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propositions of the items that pass."""
    found, sources = _checked(spark, sf_dir)
    return M.propositions(found, sources)


_DECISIONS = """SELECT 'dec-' || CAST(event_id AS STRING) AS id, CASE CAST(event_id % 11 AS INT) WHEN 0 THEN 'unheard_of' WHEN 1 THEN 'source_target_link' WHEN 2 THEN ' proposition ' ELSE 'proposition' END AS artifact_type, 'art-' || CAST(event_id % 3100 AS STRING) AS artifact_id, CASE WHEN event_id % 7 = 0 THEN 'approved' ELSE 'Overridden' END AS decision,
 CASE CAST(event_id % 13 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '{{"label": 5}}' WHEN 2 THEN '["label"]' WHEN 3 THEN '{{"label": null}}' WHEN 4 THEN '{{"authority": null, "label": "new"}}' WHEN 5 THEN '{{"conditions": ["a", 1]}}' WHEN 6 THEN '{{"conditions": []}}' WHEN 7 THEN '{{"review_status": "gone"}}' WHEN 8 THEN '{{"evidence": "x", "review_status": "accepted"}}' WHEN 9 THEN 'no json' WHEN 10 THEN '{{"unknown": [1]}}' ELSE '{{"label": "again", "conditions": ["c"]}}' END AS replacement FROM {events} WHERE event_id < 6000"""
_ARTEFACTS = "SELECT CASE WHEN event_id % 2 = 0 THEN 'proposition' ELSE 'source_target_link' END AS artifact_type, 'art-' || CAST(event_id AS STRING) AS artifact_id FROM {events} WHERE event_id < 3000 UNION ALL SELECT 'proposition', 'art-' || CAST(event_id AS STRING) FROM {events} WHERE event_id < 3000 AND event_id % 4 = 1"
_PROPS = "SELECT 'art-' || CAST(event_id AS STRING) AS id, event_type AS label, CASE WHEN event_id % 2 = 0 THEN 'board' END AS authority, 'proposed' AS review_status FROM {events} WHERE event_id < 4000"


def override_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides that can't be laid over their artefact."""
    return O.override_faults(_rows(spark, sf_dir, _DECISIONS), _rows(spark, sf_dir, _ARTEFACTS))


def overridden_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propositions under the valid overrides of their last decisions."""
    decisions = _rows(spark, sf_dir, _DECISIONS).filter("artifact_type = 'proposition'")
    last = decisions.groupBy("artifact_id").agg(F.max_by(F.struct("id", "artifact_type", "decision", "replacement"), F.length("id") * 1_000_000 + F.substring_index("id", "-", -1).cast("int")).alias("d")).select("artifact_id", "d.*")
    return O.overridden(_rows(spark, sf_dir, _PROPS), last, "proposition")


_NORM = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
_SAID = {
    "invalid_row_type": "expected object", "empty_proposition": "proposition_text empty", "empty_evidence_no_reason": "evidence_text empty but reason does not explain why (copy verbatim or leave empty only with justification)", "no_verbatim_normalized_span": "evidence_text not traceable to source",
    "duplicate_proposition_same_locator": "duplicate proposition_text for same locator", "invalid_provision_type": "invalid provision_type", "invalid_completeness": "invalid completeness_status",
}
_CHECKED_SQL = f"""
items AS ({_ITEMS.format(events="events")}), src AS ({_SOURCES.format(events="events")}),
n AS (SELECT items.*, (row_number() OVER (PARTITION BY source_id ORDER BY ord) - 1)::INTEGER AS row_index, coalesce(source_text, '') AS st FROM items LEFT JOIN src USING (source_id)),
e AS (SELECT *, CASE WHEN NOT odd AND trim(evidence_text) <> '' AND contains({_NORM.format("st")}, {_NORM.format("evidence_text")}) THEN 'plain' ELSE '' END AS strategy FROM n),
f AS (SELECT *, CASE WHEN odd THEN 'invalid_row_type' WHEN trim(proposition_text) = '' THEN 'empty_proposition' WHEN trim(evidence_text) = '' AND trim(reason) = '' THEN 'empty_evidence_no_reason' WHEN trim(evidence_text) <> '' AND strategy = '' THEN 'no_verbatim_normalized_span' END AS early FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY source_id, early IS NULL, CASE WHEN odd THEN '' ELSE {_NORM.format("proposition_text")} END, CASE WHEN odd THEN '' ELSE lower(trim(source_locator)) END ORDER BY row_index) AS nth FROM f),
h AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN nth > 1 THEN 'duplicate_proposition_same_locator' WHEN provision_type = 'strange' THEN 'invalid_provision_type' WHEN completeness_status = 'half' THEN 'invalid_completeness' END AS reason_code FROM g),
k AS (SELECT *, coalesce(count(*) FILTER (reason_code IS NULL) OVER (PARTITION BY source_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM h),
chk AS (SELECT *, CASE WHEN reason_code IS NULL THEN seen END AS accepted_index FROM k WHERE seen < {LIMIT})"""
_CHECKS_SQL = f"WITH {_CHECKED_SQL} SELECT source_id, row_index, reason_code, 'row ' || row_index || ': ' || CASE reason_code {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _SAID.items())} END AS failure_reason, strategy, accepted_index FROM chk"
_FAULT_SQL = """
d AS (SELECT id, trim(artifact_type) AS artifact_type, artifact_id, lower(decision) AS decision, replacement, event_id % 13 AS k FROM (SELECT *, substr(id, 5)::BIGINT AS event_id FROM dec)), a AS (SELECT DISTINCT artifact_type, artifact_id, true AS there FROM art),
o AS (SELECT d.*, there FROM d LEFT JOIN a USING (artifact_type, artifact_id) WHERE decision = 'overridden' AND replacement IS NOT NULL),
x AS (SELECT *, CASE WHEN artifact_type = 'unheard_of' THEN 'unsupported artifact_type' WHEN there IS NULL THEN 'missing artifact' WHEN k IN (2, 9) THEN 'replacement is no object'
  WHEN artifact_type = 'proposition' THEN CASE k WHEN 1 THEN 'label: found BIGINT' WHEN 3 THEN 'label: found VOID' WHEN 5 THEN 'conditions: found ARRAY<VARIANT>' WHEN 7 THEN 'review_status: found STRING' END WHEN artifact_type = 'source_target_link' THEN CASE k WHEN 8 THEN 'evidence: found STRING' END END AS fault FROM o)"""
_DEC, _ART = _DECISIONS.format(events="events"), _ARTEFACTS.format(events="events")
_FAULTS_SQL = f"WITH dec AS ({_DEC}), art AS ({_ART}),{_FAULT_SQL} SELECT id, CASE WHEN artifact_type = 'unheard_of' THEN 'L1' WHEN there IS NULL THEN 'L2' ELSE 'L3' END AS rule, artifact_type, artifact_id, fault FROM x WHERE fault IS NOT NULL"
_OVER_SQL = f"""WITH raw AS ({_DEC}), dec AS (SELECT * FROM raw WHERE artifact_type = 'proposition' QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY length(id) * 1000000 + substr(id, 5)::BIGINT DESC) = 1), p AS ({_PROPS.format(events="events")}), art AS (SELECT 'proposition' AS artifact_type, id AS artifact_id FROM p),{_FAULT_SQL},
v AS (SELECT artifact_id AS id, replacement::JSON AS j FROM x WHERE fault IS NULL)
SELECT p.id, CASE WHEN j IS NOT NULL AND json_exists(j, '$.label') THEN j->>'$.label' ELSE label END AS label, CASE WHEN j IS NOT NULL AND json_exists(j, '$.authority') THEN j->>'$.authority' ELSE authority END AS authority, CASE WHEN j IS NOT NULL AND json_exists(j, '$.review_status') THEN j->>'$.review_status' ELSE review_status END AS review_status, j IS NOT NULL AS overridden FROM p LEFT JOIN v USING (id)"""

QUERIES = {
    "model_row_checks": (model_row_checks, _CHECKS_SQL),
    "model_propositions": (model_propositions, None),
    "override_faults": (override_faults, _FAULTS_SQL),
    "overridden_propositions": (overridden_propositions, _OVER_SQL),
}

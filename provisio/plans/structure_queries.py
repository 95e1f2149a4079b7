"""The query over structured propositions, with the DuckDB SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import structure as S
from .fixture import SENTENCES, _pick

SAID = [
    *SENTENCES,
    "Member States shall not require a permit, where the goods are in transit, unless the authority objects, if a risk exists.",
    "This derogation applies until 31 March 2027; it may be renewed.",
    "From 1 January 2026, operators must not use the old form, provided that the new one is issued.",
    'For this chapter "holding" means a place, subject to Article 4.',
    "The term keeper means any person who has the right to move animals.",
    "Importers are required to notify in accordance with Article 12, without prejudice to Directive 92/1.",
    "By way of derogation, paragraph 2 does not apply to zoos.",
    "Approvals granted before 21 April 2021 will remain valid, until revoked.",
    "Transitional rules.",
    "During the breeding season the operator is not permitted to   move stock; unless the vet agrees",
    "Records, as laid down in Annex II, might be kept by hand, to the extent that no system exists, from 2026-01-01.",
    "until the end",
    "",
]
_ROWS = f"SELECT event_id AS id, {_pick('event_id * 13 % 5003', SAID)} || CASE WHEN event_id % 5 = 0 THEN ' It will apply until ' || event_type || ' ends.' ELSE '' END AS said FROM {{events}}"


def structured_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with their subject, rule, object, conditions, type and times."""
    rows = spark.sql(_ROWS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return S.with_structure(rows, "said").drop("said")


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _is(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?i){_q(pattern)}')"


def _at(text: str, pattern: str) -> str:
    return f"CASE WHEN {_is(text, pattern)} THEN length(regexp_extract({text}, '(?i)^(.*?){_q(pattern)}', 1)) ELSE -1 END"


def _of(text: str, pattern: str) -> str:
    return rf"nullif(trim(regexp_replace(regexp_extract({text}, '(?i){_q(pattern)}', 1), '\s+', ' ', 'g')), '')"


_TEMPORAL = rf"(p <> '' AND ({_is('p', r'\btransitional\b')} OR {_is('p', r'^(?:until|from|before|during)\b')} OR ({_is('p', S.DATE)} AND {_is('p', r'\b(?:until|from|before)\s+')}) OR {_is('p', r'\bduring\s+')}))"
STRUCTURE_SQL = rf"""
WITH r AS (SELECT id, trim(regexp_replace(said, '\s+', ' ', 'g')) AS t FROM ({_ROWS.format(events="events")})),
u AS (SELECT DISTINCT t FROM r),
c AS (SELECT t, list_min(list_filter([{", ".join(_at("t", p) for p in S.TAILS)}], lambda x: x >= {S.TAIL_FROM})) AS cut FROM u),
d AS (SELECT t, CASE WHEN cut IS NULL THEN t ELSE trim(left(t, cut)) END AS s, CASE WHEN cut IS NOT NULL THEN trim(regexp_replace(trim(regexp_replace(substr(t, cut + 1), '^\s*,\s*', '')), '^;\s*', '')) END AS tail FROM c),
e AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(tail, '(?i){S.STACKED}', chr(1) || '\1', 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> '' AND NOT {_TEMPORAL}) AS conds,
  list_min(list_filter([{", ".join(f"{{'start': {_at('s', p)}, 'less': -length(regexp_extract(s, '(?i){_q(p)}'))}}" for p in S.RULES)}], lambda h: h.start >= 0)) AS hit,
  list_filter(['Valid until: ' || {_of("t", S.UNTIL)}, 'Valid from: ' || {_of("t", S.FROM)}, CASE WHEN {_is(_of("t", S.BEFORE), S.DATE)} OR {_is(_of("t", S.BEFORE), rf"\b(?:{S.MONTHS})\b")} THEN 'Valid before: ' || {_of("t", S.BEFORE)} END, 'Applies during: ' || {_of("t", S.DURING)}], lambda x: x IS NOT NULL) AS labels FROM d),
f AS (SELECT *, len(labels) > 0 OR {_is("t", r"\btransitional\b")} OR {_is("t", r"\buntil\s+")} OR {_is("t", S.FROM_DATE)} OR ({_is("t", r"\bbefore\s+")} AND {_is("t", S.DATE)}) OR {_is("t", r"\bduring\s+")} AS cue, {_of("t", S.SOFT_UNTIL)} AS soft FROM e),
g AS (SELECT t, CASE WHEN hit IS NULL THEN '' ELSE trim(regexp_replace(trim(left(s, hit.start)), '[,:;]+$', '')) END AS subject, CASE WHEN hit IS NULL THEN '' ELSE substr(s, hit.start + 1, -hit.less) END AS rule, CASE WHEN hit IS NULL THEN '' ELSE trim(regexp_replace(trim(substr(s, hit.start - hit.less + 1)), '^[,:;-]\s*', '')) END AS object,
  coalesce(conds, []) AS conditions, CASE WHEN hit IS NULL THEN s ELSE '' END AS core_remainder, hit IS NULL AS no_modal, CASE WHEN cue THEN 'transitional' {" ".join(f"WHEN {' OR '.join(_is('t', p) for p in ps)} THEN '{k}'" for k, ps in S.TYPES.items())} ELSE 'core' END AS provision_type,
  CASE WHEN NOT cue THEN [] WHEN {_is("t", r"\buntil\s+")} AND soft IS NOT NULL AND len(list_filter(labels, lambda x: starts_with(x, 'Valid until:'))) = 0 THEN list_append(labels, 'Valid until: ' || soft) ELSE labels END AS temporal_labels FROM f)
SELECT id, subject, rule, object, conditions, core_remainder, no_modal, provision_type, temporal_labels FROM r JOIN g USING (t)
"""

QUERIES = {"structured_propositions": (structured_propositions, STRUCTURE_SQL)}

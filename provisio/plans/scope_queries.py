"""Queries over the evidence of scopes, with the DuckDB SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import evidence as V
from ..sources.runs import written
from .fixture import _pick

# The seed taxonomy: scope_id (also its slug), label, parent, type, synonyms.
TAXONOMY = [
    ("animal", "Animal", None, "species", []),
    ("terrestrial_animal", "Terrestrial animal", "animal", "species", ["terrestrial"]),
    ("kept_terrestrial_animal", "Kept terrestrial animal", "terrestrial_animal", "species", []),
    ("equine", "Equine", "kept_terrestrial_animal", "species", ["equidae", "equid", "horse", "horses"]),
    ("bovine", "Bovine", "kept_terrestrial_animal", "species", ["cattle", "bovidae"]),
    ("identification_traceability", "Identification and traceability", None, "subject", ["identification", "traceability", "tagging", "ear tag"]),
    ("movement_control", "Movement control", None, "process", ["movement", "movement licence", "transport"]),
    ("certification", "Certification", None, "process", ["certificate", "certified"]),
    ("establishments", "Establishments", None, "institution", ["establishment", "premises", "holding"]),
    ("disease_control", "Disease control", None, "disease", ["disease", "biosecurity", "surveillance"]),
    ("database_registration", "Database registration", None, "process", ["database", "registry", "registration"]),
]
SAID = [
    "Operators must update the bovine herd register before each movement.",
    "Member States shall record database information for species other than bovine, ovine, caprine, porcine and equine when rules so provide.",
    "Member States must record identification data on kept animals of the equine species.",
    "Operators shall identify equidae before movement.",
    "Operators must keep records for livestock movement.",
    "Authorities shall maintain an identification register.",
    "Operators shall register each animal before movement.",
    "There is a levy on oats purchased for bedding.",
    "The keeper must identify each horse before movement.",
    "Database registration is required for cattle movement certificates.",
    "The ear tags of   kept terrestrial animals   shall be renewed, excluding those of an equine at the holding.",
    "Keepers of cattle and of horses shall report a disease at the premises.",
    "Unrelated semihorse and cattlegrid words say nothing.",
    "The rules on other species, other than those referred to in points (a) to (d), apply to transport.",
    "Persons transporting sheep must carry the movement licence.",
]
LABELS = ["Equine passport logistics dashboard", "Register obligations", "Transport, except as to cattle, excluding horses", "", "Holding duty"]
ACTORS = ["operator", "keeper of equidae", "member state", "authority of the premises", ""]
SOURCES = [
    ("Derogation for equine passports and bovine herds", "EU-TEST", "Operators must update herd registers. Bovine herds only."),
    ("Database regulation", "REF", "General animal health preamble with no equine paragraph."),
    ("Identification requirements", "REF surveillance", "The identification document for equidae shall contain the transponder reference."),
    ("Agricultural charges", "AG-99", "Unrelated preamble. " + "context filler. " * 40 + "The farmer kept many horses for draught work historically, excluding cattle."),
    ("Livestock register", "REF", "No species-specific terms appear in this source fragment. " + "Nothing here. " * 30 + "Operators must keep records for livestock. " + "More of it. " * 10 + "Bovidae near the place."),
    ("Animal health certificate", "", ""),
    ("x", "y", "Keepers report. " + "long text " * 60 + "authorities " + "and more " * 30 + "premises of terrestrial animals under surveillance"),
]
_PROPS = f"""
SELECT 'prop-' || lpad(CAST(event_id AS STRING), 9, '0') AS id, 'src-' || CAST(user_id * 5 % {len(SOURCES) + 1} AS STRING) AS source_record_id,
       {_pick("event_id * 11 % 4999", SAID)} || CASE WHEN event_id % 6 = 0 THEN ' The ' || event_type || ' transport follows.' ELSE '' END AS proposition_text,
       {_pick("event_id % 3001", LABELS)} AS label, {_pick("user_id % 2003", ACTORS)} AS legal_subject
FROM {{events}}"""
_SOURCE_ROWS = [(f"src-{i}", *s) for i, s in enumerate(SOURCES)]


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Propositions made of events; the sources they come from, one of which is missing; the taxonomy."""
    props = spark.sql(_PROPS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    sources = spark.createDataFrame(_SOURCE_ROWS, "id string, title string, citation string, authoritative_text string")
    scopes = spark.createDataFrame([(s[0], s[0], *s[1:], "active") for s in TAXONOMY], "scope_id string, slug string, label string, parent_scope_id string, scope_type string, synonyms array<string>, status string")
    return props, sources, scopes


def scope_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best evidence of each scope in each proposition, with its place and whether other species are meant."""
    return V.scope_evidence(*_tables(spark, sf_dir))


def scope_evidence_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the scopes above."""
    props, sources, scopes = _tables(spark, sf_dir)
    return V.inherited_evidence(written(V.scope_evidence(props, sources, scopes), "links"), scopes)


def scope_review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer of the links should look at."""
    props, sources, scopes = _tables(spark, sf_dir)
    links = written(V.scope_evidence(props, sources, scopes), "links")  # read four times
    return V.review_candidates(links, V.inherited_evidence(links, scopes), scopes, "run-1")


def _terms() -> list[tuple[str, str, int]]:
    rows = []
    for scope, label, _, _, synonyms in TAXONOMY:
        words = scope.replace("_", " ")
        distinct = list(dict.fromkeys([words, *words.split(), label.lower(), *synonyms]))
        rows += [(scope, t, i) for i, t in enumerate(sorted(distinct, key=len, reverse=True))]
    return rows


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_N = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
#: Where a term begins in a text, from 0; -1 if nowhere.
_AT = r"CASE WHEN NOT contains({0}, term) THEN -1 WHEN NOT regexp_matches({0}, '\b' || term || tail) THEN -1 ELSE length(regexp_extract({0}, '^(.*?)\b' || term || tail, 1)) END"
_EVIDENCE_SQL = rf"""
props AS (SELECT *, {_N.format("proposition_text")} AS said FROM ({_PROPS.format(events="events")})),
sources AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(_text, r)) + ")" for r in _SOURCE_ROWS)}) v(id, title, citation, body)),
terms AS (SELECT *, CASE WHEN contains(term, ' ') THEN '' ELSE '\b' END AS tail FROM (VALUES {", ".join(f"('{s}', '{t}', {i})" for s, t, i in _terms())}) v(scope_id, term, place)),
scopes AS (SELECT * FROM (VALUES {", ".join(f"('{s[0]}', {_text(s[2])}, '{s[3]}')" for s in TAXONOMY)}) v(scope_id, parent, scope_type)),
own AS (SELECT id, said, 0 AS look, 'proposition_text' AS field, said AS text FROM props UNION ALL SELECT id, said, 1, 'legal_subject', {_N.format("legal_subject")} FROM props UNION ALL SELECT id, said, 8, 'proposition_label', {_N.format("label")} FROM props),
theirs AS (SELECT id, 5 AS look, 'body' AS field, {_N.format("left(body, 8000)")} AS text FROM sources UNION ALL SELECT id, 6, 'source_citation', {_N.format("citation")} FROM sources UNION ALL SELECT id, 7, 'source_title', {_N.format("title")} FROM sources),
texts AS (SELECT DISTINCT field, text FROM own UNION SELECT field, text FROM theirs),
spans AS (SELECT field, text, scope_id, term, place, start, start + length(term) AS stop FROM (SELECT *, {_AT.format("text")} AS start FROM texts, terms) WHERE start >= 0),
shown AS (SELECT *, (CASE WHEN start > 100 THEN '…' ELSE '' END) || trim(substr(text, greatest(0, start - 100) + 1, least(length(text), stop + 100) - greatest(0, start - 100))) || (CASE WHEN stop + 100 < length(text) THEN '…' ELSE '' END) AS excerpt,
  field IN ('proposition_text', 'proposition_label', 'body') AND regexp_matches(substr(text, greatest(0, start - 360) + 1, start - greatest(0, start - 360)), '{V.EXCLUSION}') AS excluded FROM spans),
pairs AS (SELECT DISTINCT said, t.id AS source, t.text AS body FROM props JOIN theirs t ON source_record_id = t.id AND field = 'body' WHERE t.text <> ''),
words AS (SELECT said, source, body, unnest(string_split(said, ' ')) AS term, '\b' AS tail, generate_subscripts(string_split(said, ' '), 1) AS i FROM pairs),
spots AS (SELECT said, source, arg_min((2 * spot + length(term)) // 2, (-length(term), i)) AS anchor FROM (SELECT *, {_AT.format("body").replace("|| term ||", "|| regexp_escape(term) ||")} AS spot FROM words WHERE length(term) >= 5) WHERE spot >= 0 GROUP BY 1, 2),
anchors AS (SELECT p.said, p.source, coalesce(s.anchor, {", ".join(f"CASE WHEN length(p.said) >= {n} AND contains(body, left(p.said, {n})) THEN strpos(body, left(p.said, {n})) - 1 + {n // 2} END" for n in V.ANCHOR_PREFIXES)}, length(body) // 2) AS anchor FROM pairs p LEFT JOIN spots s USING (said, source)),
every AS (SELECT own.id, said, scope_id, term, place, look, field, excerpt, excluded FROM own JOIN shown USING (field, text)
  UNION ALL SELECT p.id, p.said, scope_id, term, place, t.look, CASE WHEN field <> 'body' THEN field WHEN abs((start + stop) / 2.0 - anchor) <= 250 THEN 'source_fragment_text' ELSE 'source_context' END, excerpt, excluded
    FROM props p JOIN theirs t ON source_record_id = t.id JOIN shown USING (field, text) LEFT JOIN anchors a ON a.said = p.said AND a.source = t.id),
ranks AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {i}, '{r}', '{c}')" for i, (f, r, c) in enumerate(V.FIELDS))}) v(field, rank, relevance, confidence)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, scope_id, term ORDER BY look) AS nth FROM every) WHERE nth = 1),
best AS (SELECT * FROM (SELECT f.*, relevance, confidence, row_number() OVER (PARTITION BY id, scope_id ORDER BY rank, place) AS first FROM firsts f JOIN ranks USING (field)) WHERE first = 1),
flags AS (SELECT *, scope_id = 'equine' AND NOT regexp_matches(said, '{V.SUBJECTS["equine"]}') AS about, regexp_matches(said, '{V.CROSS_REFERENCE}') AS crossing FROM best),
fallen AS (SELECT *, about AND (crossing OR excluded) AND NOT (relevance = 'contextual' AND confidence = 'low') AS down FROM flags),
links AS (SELECT 'psl:' || left(sha256(id || '|' || scope_id || '|explicit|' || term), 16) AS link_id, id, scope_id, term, field, CASE WHEN down THEN 'contextual' ELSE relevance END AS relevance, CASE WHEN down THEN 'medium' ELSE confidence END AS confidence, excerpt, down OR (about AND crossing) AS species_exclusion FROM fallen),
up AS (SELECT scope_id, parent AS ancestor, 1 AS depth FROM scopes WHERE parent IS NOT NULL UNION ALL SELECT up.scope_id, parent, depth + 1 FROM up JOIN scopes ON scopes.scope_id = ancestor WHERE parent IS NOT NULL),
above AS (SELECT 'psl:' || left(sha256(id || '|' || ancestor || '|inherited|' || child.n), 16) AS link_id, id, ancestor AS scope_id, child.n AS narrower, CASE WHEN child.w THEN 'low' ELSE 'medium' END AS confidence, child.w AS from_weak
  FROM (SELECT id, ancestor, min({{'w': confidence = 'low', 'd': depth, 'n': scope_id}}) AS child FROM links JOIN up USING (scope_id) GROUP BY 1, 2) WHERE (id, ancestor) NOT IN (SELECT id, scope_id FROM links))"""
_CANDIDATES_SQL = """
c AS (SELECT id, scope_id, 'weak_source_context_only' AS kind, []::VARCHAR[] AS related, [excerpt] AS snippets FROM links WHERE field = 'source_context' AND confidence = 'low'
  UNION ALL SELECT id, min(scope_id), 'sibling_species_ambiguity', list(scope_id ORDER BY scope_id), list(excerpt ORDER BY scope_id) FROM links JOIN scopes USING (scope_id) WHERE scope_type = 'species' AND parent IS NOT NULL GROUP BY id, parent HAVING count(*) > 1
  UNION ALL SELECT id, scope_id, 'inherited_from_weak_child', [narrower, scope_id], ['narrower_scope:' || narrower] FROM above WHERE from_weak)
SELECT 'lscr:' || left(sha256('run-1|' || id || '|' || scope_id || '|' || kind || '|' || array_to_string(related, '|')), 16) AS candidate_id, * FROM c"""

QUERIES = {
    "scope_evidence": (scope_evidence, f"WITH RECURSIVE {_EVIDENCE_SQL} SELECT * FROM links"),
    "scope_evidence_inherited": (scope_evidence_inherited, f"WITH RECURSIVE {_EVIDENCE_SQL} SELECT * FROM above"),
    "scope_review_candidates": (scope_review_candidates, f"WITH RECURSIVE {_EVIDENCE_SQL},{_CANDIDATES_SQL}"),
}

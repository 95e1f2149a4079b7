"""Regulatory text for queries: the given tables hold none, so rows of `events` pick sentences and locators.

LAW is SQL that Spark and DuckDB read alike; {events} stands for the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SENTENCES = [
    "The operator must keep a register of every animal before the movement takes place.",
    "The keeper shall notify the competent authority within 7 days after the arrival of the consignment, if the animal is not identified.",
    "Article 5a. Importers shall present the certificate where the appropriate authority requires it.",
    "A person may not move an animal unless the record is complete; (a) the owner must sign it; (b) the vet shall inspect it.",
    "This Regulation applies to establishments that are required to submit a return.",
    "This Article shall not affect Member State rules on inspection.",
    "For the purposes of this Regulation, 'holding' means any place where animals are kept.",
    "See Annex II to Directive 2009/156.",
    "(a) the name of the keeper",
    "Exporters are prohibited from using a licence issued by the Commission when it has expired.",
    "The   transponder shall be   registered.  The owner must hold an authorisation.",
    "those animals must be kept apart until the authority has decided.",
    "Section 12 requires every operator to maintain records, where practicable, before 1 May.",
    "No trace",
    "Regulation 9: the member state shall ensure that the information is recorded.",
    "That database must be available to the competent authority after 2016.",
]
LOCATORS = [
    "article:109:list:1-d-i", "eu:article:109:list:1__d", "Article 109(1)(d)", "Article 5(2)", "article:5:para:2", "article-5-para-2",
    "article_109_1_d_i", "document:full", "", "section:12", "annex:II", "article:7|chunk:003",
    "recital:14", "ns1:article:12a", "Article 12A", "article:109/extra",
]
JURISDICTIONS = ["EU", "European Union", "uk", "Scotland", " GB ", ""]


def _pick(column: str, values: list[str], step: int = 1) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(values))
    return f"CASE CAST({column} / {step} AS BIGINT) % {len(values)} {cases} END"


LAW = f"""
SELECT event_id AS ord, 'prop-' || lpad(CAST(event_id AS STRING), 9, '0') AS id, user_id, ts, event_type, value,
       'src-' || CAST(user_id % 9 AS STRING) AS source_record_id, 'snap-' || CAST(user_id % 9 AS STRING) || '-v' || CAST(event_id % 3 AS STRING) AS source_snapshot_id,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'frag-' || CAST(event_id % 50 AS STRING) END AS source_fragment_id,
       {_pick("event_id % 7919", LOCATORS)} AS fragment_locator, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'Article ' || CAST(event_id % 23 AS STRING) END AS article_reference,
       {_pick("user_id % 6007", JURISDICTIONS)} AS jurisdiction,
       {_pick("event_id * 7 % 1009", SENTENCES)} || CASE WHEN event_id % 4 = 0 THEN ' The ' || event_type || ' record shall follow.' ELSE '' END AS proposition_text
FROM {{events}}
"""


def law(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LAW, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


#: The same rows for the SQL of a query, as the first of its WITH clauses.
LAW_SQL = "law AS (" + LAW.format(events="events") + ")"

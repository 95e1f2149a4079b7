"""Sources: case files, legislation XML, ingestion into records, snapshots and fragments, and a snapshot cache."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import locators as L
from ..functions import text as T

CASE_SCHEMA = """
topic struct<name: string, description: string, subject_tags: array<string>>, cluster struct<name: string, description: string>,
sources array<struct<id: string, title: string, jurisdiction: string, citation: string, kind: string, provenance: string, as_of_date: date,
  retrieved_at: timestamp, version_id: string, fragment_locator: string, review_status: string, source_url: string, text: string>>,
comparison struct<jurisdiction_a: string, jurisdiction_b: string, proposition_index: int>, run_notes string
"""
# Texts of a legislation page that are no law, and locators that are operative or not.
NOISE = ["changes to legislation", "no changes have been applied", "introductory text", "opening options", "more resources", "correction slips", "impact assessments", "explanatory memorandum", "explanatory notes", "policy notes", "show timeline", "geographical extent", "commencement information", "extent information", "annotations", "table of contents", "print options"]
NOT_OPERATIVE, OPERATIVE = ["introduction", "preamble", "recital", "note"], ["article", "section", "regulation", "paragraph", "schedule", "chapter", "part"]
KINDS = ["article", "section", "regulation", "paragraph", "schedule"]
SERIES = {"asp": "Scotland", "ssi": "Scotland", "wsi": "Wales", "asc": "Wales", "anaw": "Wales", "nia": "Northern Ireland", "nisr": "Northern Ireland"}
PROVISIONS, SKIPPED = {"P1", "P2", "P3", "P4", "P5", "P6", "P"}, {"Contents", "Footnotes", "Commentaries", "Metadata"}


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON case file, with a declared schema."""
    return spark.read.schema(CASE_SCHEMA).json(path, multiLine=True)


def case_sources(cases: DataFrame) -> DataFrame:
    """One row for each source of each case, in its order (ord)."""
    return cases.select("topic", F.posexplode("sources").alias("ord", "s")).select("ord", F.col("topic.name").alias("topic"), "s.*")


def is_noise(text: Column) -> Column:
    low = F.lower(text)
    return (F.length(low) < 4) | T.any_in(low, NOISE) | low.startswith("status:")


def is_operative_locator(locator: Column) -> Column:
    low = F.lower(F.coalesce(locator, F.lit("")))
    return ~T.any_in(low, NOT_OPERATIVE) & T.any_in(low, OPERATIVE)


def is_operative_text(text: Column, locator: Column) -> Column:
    low = F.lower(text)
    heading = low.rlike(f"^({'|'.join(KINDS)}) ")
    return is_operative_locator(locator) | (~low.startswith("whereas ") & (T.any_in(low, ["must", "shall", "may"]) | heading))


def locator_of(text: Column) -> Column:
    """kind:number of the first kind, in their order, that the text names; null for none."""
    found = [(k, F.lower(F.regexp_extract(text, rf"(?i)\b{k}\s+(\d+[a-z]?)\b", 1))) for k in KINDS]
    return F.coalesce(*(F.when(n != "", F.concat(F.lit(k + ":"), n)) for k, n in found))


def series_jurisdiction(series: Column) -> Column:
    out = F.when(F.lower(series) == "ukpga", "UK")
    for code, name in SERIES.items():
        out = out.when(F.lower(series) == code, name)
    return out.otherwise("UK")


def ingest(raw: DataFrame) -> dict[str, DataFrame]:
    """Records, snapshots, fragments, parse traces and first reviews of raw sources.

    raw: ord, id (or null), title, jurisdiction, citation, kind, text, version_id, fragment_locator, provenance,
    source_url. Blank optional fields take their defaults; the content hash is SHA-256 of the text.
    """
    given = lambda c, default: F.coalesce(T.blank_to_null(F.col(c)), F.lit(default))
    nth = (F.col("ord") + 1).cast("string")
    made = F.concat(F.lit("src-"), T.slug(F.col("jurisdiction")), F.lit("-"), F.when(F.length(nth) < 3, F.lpad(nth, 3, "0")).otherwise(nth))
    rows = raw.withColumns({
        "id": F.coalesce(T.blank_to_null(F.col("id")), made), "version_id": given("version_id", "v1"), "authoritative_locator": given("fragment_locator", "document:full"),
        "provenance": given("provenance", "demo.case_file"), "content_hash": T.content_hash(F.coalesce("text", F.lit(""))),
    })
    rows = rows.withColumns({"snapshot_id": F.concat(F.lit("snap-"), T.slug(F.col("id")), F.lit("-"), F.col("version_id")), "fragment_id": F.concat(F.lit("frag-"), T.slug(F.col("id")), F.lit("-001"))})
    fragments = rows.select(F.col("fragment_id").alias("id"), F.col("id").alias("source_record_id"), F.col("snapshot_id").alias("source_snapshot_id"), F.col("authoritative_locator").alias("locator"), L.fragment_type(F.col("authoritative_locator")).alias("fragment_type"), F.col("text").alias("fragment_text"), F.col("content_hash").alias("text_hash"))
    return {
        "sources": rows.select("id", "title", "jurisdiction", "citation", "kind", "authoritative_locator", "provenance", "content_hash", "version_id", F.col("snapshot_id").alias("current_snapshot_id"), "source_url"),
        "snapshots": rows.select(F.col("snapshot_id").alias("id"), F.col("id").alias("source_record_id"), "version_id", "content_hash", "provenance"),
        "fragments": fragments,
        "parse_traces": fragments.groupBy("source_snapshot_id", "source_record_id").agg(F.count(F.lit(1)).alias("fragment_count"), F.lit("success").alias("status")),
        "reviews": rows.select(F.concat(F.lit("review-"), F.col("id")).alias("id"), F.lit("source").alias("target_type"), F.col("id").alias("target_id"), F.lit("proposed").alias("new_status")),
    }


def cache_key(authority: Column, source_id: Column, jurisdiction: Column, citation: Column, version: Column, digest: Column) -> Column:
    """SHA-256 over authority, identity of the source, version and content: equal texts of two sources stay apart."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return T.content_hash(F.concat_ws("|", low(authority), low(source_id), low(jurisdiction), low(citation), F.trim(version), low(digest)))


def fetch_status(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key) against the cache (key, stored_at): cache_hit or success, with the latest cached time."""
    latest = cache.groupBy("key").agg(F.max("stored_at").alias("stored_at"))
    return requests.join(latest, "key", "left").withColumn("status", F.when(F.col("stored_at").isNotNull(), "cache_hit").otherwise("success"))


def _provisions(xml: str) -> list[tuple[int, str, str]]:
    """(ord, locator, text) of identified provisions outside notes and contents; the first of a locator counts."""
    found, seen = [], set()
    local = lambda tag: tag.rpartition("}")[2]

    try:
        waiting = [ElementTree.fromstring(xml)]
    except ElementTree.ParseError:
        return []
    while waiting:  # in document order, to any depth
        node = waiting.pop()
        if local(node.tag) in SKIPPED:
            continue
        place = node.get("id") or node.get("eId") or node.get("DocumentURI")
        if local(node.tag) in PROVISIONS and place and place not in seen:
            text = " ".join("".join(node.itertext()).split())
            if text:
                seen.add(place)
                found.append((len(found), f"xml:{place}", text))
        waiting.extend(reversed(node))
    return found


def legislation_provisions(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """id, ord, locator, text of the provisions of each XML text; broken or null XML gives none. Noise is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(i, *p) for i, xml in zip(frame["id"], frame["xml"], strict=True) for p in _provisions(xml)]
            yield pd.DataFrame(rows, columns=["id", "ord", "locator", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(xml_col), F.lit("")).alias("xml"))
    cut = rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, ord int, locator string, text string")
    return cut.filter(~is_noise(F.col("text")))

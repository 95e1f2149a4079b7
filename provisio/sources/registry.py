"""A registry of sources and the search in it: identifiers read from free text, candidates by joins on them.

Entries: registry_id, authority, authority_source_id, title, citation, jurisdiction, source_url and `ord`, their place.
An identifier is series/year/number in lower case, the number without leading zeros. Nothing is fetched: candidates come
from a table of known sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import any_in, slug, squash

# The series in the order in which a bare year/number is tried, those with an address, and the phrases.
SERIES = ["eur", "ukpga", "uksi", "asp", "ssi", "wsi", "nisr", "nia", "anaw"]
ADDRESSED = ["eur", "ukpga", "uksi", "asc", "wsi", "ssi", "nia", "nisr", "asp", "anaw"]
HOST = "legislation.gov.uk"
PHRASES_WITHIN = ["animal health law", "animal health regulation", "transmissible animal diseases"]
PHRASES_WHOLE = ["animal health", "ahl", "a h l"]
PHRASE_ID = "eur/2016/429"
MOST = 25
# How queries name identifiers, the most specific form first.
FIRST_FORMS = [r"(?i)(?:^|\s)eur\s*/\s*(20\d{2})\s*/\s*(\d{3,})\b", r"(?i)\b(?:EUR|EU)\s+(20\d{2})\s*/\s*(\d{3,})\b"]
SPACED_CELEX = r"\b(3\s*\d{4}\s*[Rr]\s*\d{3,})\b"
LAST_FORMS = [r"(?i)\bregulation\b[^0-9]{0,48}(20\d{2})\s*/\s*(\d{3,})\b", r"(?<!/)(20\d{2})\s*/\s*(\d{3,})\b"]


def _number(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def _eur(text: Column, pattern: str) -> Column:
    """eur/year/number from the first match of a pattern with a year and a number; null without one."""
    year, number = (F.regexp_extract(text, pattern, i) for i in (1, 2))
    return F.when(year != "", F.concat(F.lit("eur/"), year, F.lit("/"), _number(number)))


def normal_id(text: Column) -> Column:
    """series/year/number in its normal form; null for other texts."""
    parts = [F.regexp_extract(F.btrim(F.trim(text), F.lit("/")), r"(?i)^([a-z0-9]+)/(\d{4})/(\d+)$", i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat_ws("/", F.lower(parts[0]), parts[1], _number(parts[2])))


def id_of_url(url: Column) -> Column:
    """The identifier in an address of the legislation site; null for other texts."""
    host, path = (F.regexp_extract(F.trim(url), r"(?i)^https?://([^/?#]*)([^?#]*)", i) for i in (1, 2))
    bare = F.btrim(path, F.lit("/"))
    for end in ("^id/", "/data\\.xml$", "/made$"):
        bare = F.regexp_replace(bare, end, "")
    return F.when(F.contains(F.lower(host), F.lit(HOST)), normal_id(bare))


def celex_id(token: Column) -> Column:
    """The identifier of a CELEX number of a regulation (sector 3, kind R); null for others."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(token), r"(?i)^celex\s*:\s*", ""), r"\s+", "")
    return _eur(bare, r"^3(\d{4})[Rr](\d{2,})$")


def hints(query: Column) -> Column:
    """Identifiers that a query names, the most specific form first; empty for queries under two characters."""
    text = F.trim(query)
    one = [_eur(text, p) for p in FIRST_FORMS]
    tokens = F.transform(F.split(squash(F.translate(text, ";,", "  ")), " "), celex_id)
    spaced = F.transform(F.regexp_extract_all(text, F.lit(SPACED_CELEX), 1), celex_id)
    last = [_eur(text, p) for p in LAST_FORMS]
    named = F.reverse(F.array_compact(F.concat(F.array(*one), tokens, spaced, F.array(*last))))
    words = F.translate(squash(F.lower(text)), "-", " ")
    phrase = F.when(any_in(words, PHRASES_WITHIN) | words.isin(PHRASES_WHOLE), F.lit(PHRASE_ID))
    return F.when(F.length(text) >= 2, F.array_distinct(F.concat(named, F.array_compact(F.array(phrase))))).otherwise(F.array().cast("array<string>"))


def resolve(queries: DataFrame, catalog: DataFrame, limit: int = 10) -> DataFrame:
    """Candidates for many queries (query_id, query) from a table with authority_source_id in normal form and ord.

    An address names one source. Else identifiers written whole, or a bare year/number in the order of the series, come
    first and the hints follow; hints that fill the limit stand alone. One row for each candidate, ranked from 1, with the
    columns of its first entry. Queries without candidates give no row. Joins are on the identifier alone.
    """
    most = min(max(limit, 1), MOST)
    text = F.lower(F.trim("query"))
    bare = [F.regexp_extract(text, r"^(\d{4})/(\d+)$", i) for i in (1, 2)]
    tried = F.transform(F.array(*map(F.lit, SERIES)), lambda s: F.concat_ws("/", s, bare[0], _number(bare[1])))
    full, by_url = normal_id(text), id_of_url(F.col("query"))
    named = F.when(full.isNotNull(), F.array(full)).when(bare[0] != "", tried)
    rows = lambda ids, kind: F.coalesce(F.transform(ids, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.alias("authority_source_id"))), F.array())
    wanted = F.when(by_url.isNotNull(), rows(F.array(by_url), "url")).otherwise(F.concat(rows(named, "identifier"), rows(hints(F.col("query")), "hint")))
    asked = queries.filter(F.length(F.trim("query")) >= 2).select("query_id", F.inline(wanted))
    first = catalog.groupBy("authority_source_id").agg(F.min_by(F.struct(*catalog.columns), "ord").alias("entry"))
    by_query = Window.partitionBy("query_id")
    found = asked.join(first, "authority_source_id").withColumn("hinted", F.count_if(F.col("kind") == "hint").over(by_query))
    found = found.filter((F.col("kind") != "identifier") | (F.col("hinted") < most))
    best = found.groupBy("query_id", "authority_source_id").agg(F.min(F.struct((F.col("kind") == "hint").alias("late"), "pos")).alias("place"), F.any_value("entry").alias("entry"))
    ranked = best.withColumn("rank", F.row_number().over(by_query.orderBy("place")))
    return ranked.filter(F.col("rank") <= most).select("query_id", "rank", "entry.*")


def search_entries(entries: DataFrame, query: str) -> DataFrame:
    """Entries whose identifier a query names, or whose identifier, title or citation holds it; the first of each identifier.

    Entries without an identifier are all kept; an empty query finds nothing. Nulls count as empty.
    """
    field = lambda name: F.coalesce(F.col(name), F.lit(""))
    key, wanted = F.lower(F.trim(field("authority_source_id"))), F.lit(" ".join(query.lower().split()))
    holds = F.contains(key, wanted) | F.contains(F.lower(field("title")), wanted) | F.contains(F.lower(field("citation")), wanted)
    found = entries.withColumn("key", key).filter(F.array_contains(hints(F.lit(query)), F.col("key")) | ((wanted != "") & holds))
    named = found.filter("key != ''").groupBy("key").agg(F.min_by(F.struct(*entries.columns), "ord").alias("entry")).select("key", "entry.*")
    kept = named.unionByName(found.filter("key = ''"))
    source_id = F.trim(field("authority_source_id"))
    given = F.trim(field("source_url"))
    url = F.when(given != "", given).when(F.element_at(F.split("key", "/"), 1).isin(ADDRESSED) & F.contains("key", F.lit("/")), F.concat(F.lit(f"https://www.{HOST}/"), F.btrim(F.col("key"), F.lit("/"))))
    or_else = lambda c, other: F.when(c != "", c).otherwise(other)
    return kept.select(
        or_else(field("title"), or_else(source_id, F.lit("Untitled registry source"))).alias("title"), field("citation").alias("citation"), source_id.alias("authority_source_id"), field("jurisdiction").alias("jurisdiction"),
        or_else(field("authority"), F.lit("registry")).alias("authority"), F.coalesce(url, F.lit("")).alias("canonical_source_url"), F.lit("registry.match").alias("provenance"), "ord",
    )


def register(entries: DataFrame, references: DataFrame) -> DataFrame:
    """References (with ord) and what becomes of each: `registered`, `exists`, or `no_identifier`.

    Ids are built from authority and identifier where none is given. Of several references of one id the first is registered.
    """
    source_id = F.trim(F.coalesce("authority_source_id", F.lit("")))
    authority = F.coalesce("authority", F.lit("case_file"))
    given = F.trim(F.coalesce("registry_id", F.lit("")))
    made = F.concat(F.lit("reg-"), slug(F.concat_ws("-", authority, source_id)))
    rows = references.withColumn("registry_id", F.when(source_id != "", F.when(given != "", given).otherwise(made)))
    first = rows.filter("registry_id IS NOT NULL").groupBy("registry_id").agg(F.min("ord").alias("first_ord"))
    fresh = first.join(entries.select("registry_id"), "registry_id", "left_anti")
    status = F.when(F.col("registry_id").isNull(), "no_identifier").when(F.col("ord") == F.col("first_ord"), "registered").otherwise("exists")
    return rows.join(fresh, "registry_id", "left").withColumn("status", status).drop("first_ord")


def current_states(history: DataFrame) -> DataFrame:
    """The latest refresh of each registry_id, by refreshed_at and then seq, and how many there were."""
    return history.groupBy("registry_id").agg(F.max_by(F.struct(*[c for c in history.columns if c != "registry_id"]), F.struct("refreshed_at", "seq")).alias("state"), F.count(F.lit(1)).alias("refreshes")).select("registry_id", "state.*", "refreshes")


def case_sources(spark: SparkSession, states: DataFrame, registry_ids: list[str]) -> DataFrame:
    """The current states of the ids given, with their place in the list; an id given twice comes twice."""
    wanted = spark.createDataFrame(list(enumerate(registry_ids)), "pos int, registry_id string")
    return states.join(wanted, "registry_id")

"""Small rules of record as column expressions: tokens, fingerprints, states, budgets and filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squash

# Types of fragments that hold no rules, states that count as others, sites and marks.
NOT_OPERATIVE = ["recital", "heading", "table", "unknown", "document"]
LEGACY = ["draft", "in_review"]
ACCEPTED = ["accepted", "accepted_with_edits"]
SITE, CONTENT = "www.gov.uk", "https://www.gov.uk/api/content"
DISCOVERY, FIXTURE, SUBGROUP = "Discovery candidate only", "fixture-", "\u001e"


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def instrument_token(text: Column) -> Column:
    """The first year/number of this century in the text, or null."""
    pattern = r"\b(20\d{2})\s*/\s*(\d{3,4})\b"
    flat = F.translate(_or_empty(text), "\u00a0", " ")
    year, number = (F.regexp_extract(flat, pattern, i) for i in (1, 2))
    return F.when(year != "", F.concat(year, F.lit("/"), number))


def wording_fingerprint(text: Column, label: Column) -> Column:
    """Wording and label with white space squashed, by which members of a group are compared."""
    return F.concat(squash(_or_empty(text)), F.lit("\u001f"), squash(_or_empty(label)))


def is_operative_type(fragment_type: Column) -> Column:
    return ~_or_empty(fragment_type).isin(NOT_OPERATIVE)


def canonical_status(status: Column) -> Column:
    """Draft and in_review are proposed; other states stay."""
    return F.when(status.isin(LEGACY), "proposed").otherwise(status)


def without_subgroup(key: Column) -> Column:
    """A group's key without the article cluster that was put behind it."""
    return F.substring_index(key, SUBGROUP, 1)


def body_chars(max_tokens: Column, margin: int = 2048) -> Column:
    """Characters of a fragment that an extraction prompt of so many tokens has room for, roughly."""
    room = F.greatest(F.lit(256), max_tokens - margin) - 520
    return F.greatest(F.lit(4096), F.greatest(F.lit(128), room) * 3)


def guidance_blocks(status: Column, confidence: Column, completeness: Column) -> Column:
    """Why a proposition can't go into guidance yet, joined by "; "; empty if it can."""
    quoted = lambda c: F.concat(F.lit("'"), _or_empty(c), F.lit("'"))
    return F.concat_ws(
        "; ",
        F.when(_or_empty(confidence) != "high", F.concat(F.lit("extraction confidence is "), quoted(confidence), F.lit(", not high"))),
        F.when(~_or_empty(status).isin(ACCEPTED), F.concat(F.lit("review_status is "), quoted(status), F.lit(" (needs accepted decision)"))),
        F.when(completeness == "fragmentary", "completeness is fragmentary"),
    )


def content_address(address: Column) -> Column:
    """The address of a page's content in the interface of its site: without host, fragment and slashes at the end."""
    path = F.regexp_replace(_or_empty(address), f"https?://{SITE.replace('.', '[.]')}", "")
    return F.concat(F.lit(CONTENT), F.rtrim(F.substring_index(path, "#", 1), F.lit("/")))


def source_bucket(source_id: Column, reason: Column) -> Column:
    """fixture, discovery or included: what a row of a corpus stands for."""
    return F.when(F.startswith(_or_empty(source_id), F.lit(FIXTURE)), "fixture").when(F.contains(_or_empty(reason), F.lit(DISCOVERY)), "discovery").otherwise("included")


def scope_matches(wanted: Column, scope_id: Column, slug: Column, label: Column, synonyms: Column) -> Column:
    """Whether a filter names the scope by id, slug, label or a synonym, letter case aside; a blank filter names all."""
    norm = lambda c: F.lower(F.trim(_or_empty(c)))
    want = norm(wanted)
    return (want == "") | (want == norm(scope_id)) | (want == norm(slug)) | (want == norm(label)) | F.coalesce(F.exists(synonyms, lambda s: norm(s) == want), F.lit(False))

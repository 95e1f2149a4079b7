"""Column expressions over locators, the addresses of fragments: `article:109:list:1-d-i`, `Article 5(2)`, `document:full`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, is_placeholder, slug

#: Fragment types by the start of a locator.
PREFIX_TYPES = ["article", "annex", "section", "recital"]


def fragment_type(locator: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(locator, F.lit(""))))
    kind = F.when(low == "", "unknown").when(low == "document:full", "document").when(low.contains("|chunk:") | low.startswith("chunk:"), "chunk")
    for prefix in PREFIX_TYPES:
        kind = kind.when(low.startswith(prefix + ":"), prefix)
    return kind.otherwise("unknown")


def plain(locator: Column) -> Column:
    """The locator without what follows its first slash and without a namespace before it."""
    dashed = F.replace(F.trim(locator), F.lit("__"), F.lit("-"))
    slash = F.instr(dashed, F.lit("/"))
    head = F.when((slash > 1) & (slash <= 201), F.trim(F.substring_index(dashed, "/", 1))).otherwise(dashed)
    space = F.lower(F.substring_index(head, ":", 1))
    colon = F.instr(head, F.lit(":"))
    named = (colon > 1) & (colon <= 24) & ~space.isin("article", "section") & space.rlike("^[a-z][a-z0-9_-]{0,20}$")
    return F.when(named, F.trim(F.substr(head, colon + 1))).otherwise(head)


def _path(path: Column) -> Column:
    parts = F.transform(F.split(F.replace(path, F.lit("__"), F.lit("-")), "-"), lambda x: F.lower(F.trim(x)))
    return blank_to_null(F.array_join(F.filter(parts, lambda x: x != ""), "-"))


def lineage_key(locator: Column, bare: Column | None = None) -> Column:
    """One key for the five ways in which a locator names a list item or paragraph of an article; null for others.

    bare: plain(locator), where a column holds it already.
    """
    t = plain(locator) if bare is None else bare
    listed = t.contains(":list:")
    base, rest = F.substring_index(t, ":list:", 1), F.substring_index(F.element_at(F.split(t, ":list:"), 2), "/", 1)
    article = blank_to_null(F.lower(F.regexp_extract(base, r"(?i)(?:article|section)[:/_-]?(\d+[a-z]?)", 1)))
    from_list = F.concat(F.lit("article:"), article, F.lit(":list:"), _path(rest))
    role, number, para = (F.lower(F.regexp_extract(t, r"(?i)^(article|section):(\d+[a-z]?):para:(\d+)$", i)) for i in (1, 2, 3))
    from_colon = F.when(role != "", F.concat(role, F.lit(":"), number, F.lit(":para:"), para))
    hyphened = F.when(t.rlike("(?i)^article_"), F.replace(t, F.lit("_"), F.lit("-"))).otherwise(t)
    h_role, h_number, h_para = (F.lower(F.regexp_extract(hyphened, r"(?i)^(article|section)-(\d+[a-z]?)-para-(\d+)$", i)) for i in (1, 2, 3))
    from_hyphen = F.when(h_role != "", F.concat(h_role, F.lit(":"), h_number, F.lit(":para:"), h_para))
    s_number, tail = F.lower(F.regexp_extract(hyphened, r"(?i)^article-(\d+[a-z]?)-(\S+)$", 1)), F.replace(F.regexp_extract(hyphened, r"(?i)^article-(\d+[a-z]?)-(\S+)$", 2), F.lit("_"), F.lit("-"))
    from_slug = F.when((s_number != "") & ~tail.contains(":") & ~tail.rlike(r"(?i)^article\b") & _path(tail).contains("-"), F.concat(F.lit("article:"), s_number, F.lit(":list:"), _path(tail)))
    shape = r"(?i)^article\s+(\d+[a-z]?)\s*((?:\(\s*[^()]+\s*\))+)\s*$"
    inner = F.transform(F.regexp_extract_all(F.regexp_extract(t, shape, 2), F.lit(r"\(\s*([^()]+)\s*\)"), F.lit(1)), lambda x: F.lower(F.trim(x)))
    human = F.lower(F.regexp_extract(t, shape, 1))
    from_words = F.when((human != "") & F.get(inner, F.lit(0)).rlike(r"^\d+$"), F.when(F.size(inner) >= 2, F.concat(F.lit("article:"), human, F.lit(":list:"), F.array_join(inner, "-"))).when(F.size(inner) == 1, F.concat(F.lit("article:"), human, F.lit(":para:"), F.get(inner, F.lit(0)))))
    return F.when(is_placeholder(locator), F.lit(None)).when(F.lower(t).contains(":list:"), F.when(listed, from_list)).otherwise(F.coalesce(from_colon, from_hyphen, from_slug, from_words))


def is_coarse(locator: Column, bare: Column | None = None) -> Column:
    """Whether the locator names a whole article or section and nothing below it."""
    t = plain(locator) if bare is None else bare
    return ~is_placeholder(locator) & ~F.replace(locator, F.lit("__"), F.lit("-")).contains(":list:") & t.rlike(r"(?i)^(article|section):\d+[a-z]?$")


def list_label(locator: Column) -> Column:
    """`article:109:list:1-d-i` as `Art 109 §1(d)(i)`; null for locators of another form."""
    base, path = F.trim(F.substring_index(locator, ":list:", 1)), F.trim(F.substring_index(F.element_at(F.split(locator, ":list:", 2), 2), "/", 1))
    number = F.regexp_extract(base, r"(?i)(?:article|section)[:/_-]?(\d+[a-z]?)", 1)
    bits = F.filter(F.split(F.replace(path, F.lit("__"), F.lit("-")), "-"), lambda x: x != "")
    tail = F.array_join(F.transform(F.slice(bits, 2, 99), lambda x: F.concat(F.lit("("), x, F.lit(")"))), "")
    return F.when(F.contains(locator, F.lit(":list:")) & (F.size(bits) >= 2), F.concat(F.when(number != "", F.concat(F.lit("Art "), number)).otherwise(base), F.lit(" §"), F.get(bits, F.lit(0)), tail))


def display_segment(locator: Column, article: Column) -> Column:
    placed = F.when(~is_placeholder(locator), F.trim(locator))
    return F.coalesce(F.when(placed.isNotNull(), F.coalesce(list_label(placed), placed)), blank_to_null(article), F.lit("Source"))


def key_segment(locator: Column, article: Column, fragment_id: Column, source_id: Column) -> Column:
    """The part of a proposition's key that names its fragment."""
    raw = F.coalesce(F.when(locator != "", locator), F.when(article != "", article), fragment_id)
    return F.when(~is_placeholder(raw), slug(raw)).when(blank_to_null(fragment_id).isNotNull(), slug(fragment_id)).otherwise(slug(source_id))


def cluster_key(locator: Column, article: Column, lineage: Column | None = None, bare: Column | None = None) -> Column:
    """article:N, section:N, ref:text or loc:text: the section of the explorer a proposition is shown in."""
    bare = plain(locator) if bare is None else bare
    lineage = F.coalesce(lineage_key(locator, bare) if lineage is None else lineage, bare)
    role, number = (F.lower(F.regexp_extract(lineage, r"(?i)^(article|section)[:\s_-]+(\d+[a-z]?)", i)) for i in (1, 2))
    a_role, a_number = (F.lower(F.regexp_extract(article, r"(?i)^\s*(art(?:icle)?|section)\.?\s*(\d+[a-z]?)", i)) for i in (1, 2))
    named = F.when(a_role.startswith("art"), "article").otherwise(a_role)
    return F.coalesce(
        F.when(~is_placeholder(locator) & (role != ""), F.concat_ws(":", role, number)), F.when(a_role != "", F.concat_ws(":", named, a_number)),
        F.when(blank_to_null(article).isNotNull(), F.concat(F.lit("ref:"), F.lower(F.trim(article)))), F.when(~is_placeholder(locator), F.concat(F.lit("loc:"), F.lower(F.trim(locator)))),
    )


def cluster_heading(key: Column) -> Column:
    kind, rest = F.substring_index(key, ":", 1), F.substr(key, F.instr(key, F.lit(":")) + 1)
    return F.when(kind.isin("article", "section"), F.concat_ws(" ", F.initcap(kind), rest)).when(kind.isin("ref", "loc"), F.initcap(rest)).otherwise("Other provisions")

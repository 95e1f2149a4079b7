"""Definition provisions, which fragments are worth a call, and extraction by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.ingest import is_operative_locator
from .propositions import with_fields
from .splitting import structured_items

# Patterns of definitions, and terms that rank first.
_MARKS = "\"'‘’“”"
DEFINITION_HEADER = r"(?i)\b(?:for\s+the\s+purposes\s+of\s+this\s+(?:regulation|directive|decision|act)[^.:;\n]{0,200}\b)?the\s+following\s+definitions\s+shall\s+apply\b"
QUOTED = f"[{_MARKS}]([^{_MARKS}]{{1,180}})[{_MARKS}]"
ENTRY = rf"(?is)([{_MARKS}][^{_MARKS}]{{1,180}}[{_MARKS}](?:\s+or\s+[{_MARKS}][^{_MARKS}]{{1,180}}[{_MARKS}]){{0,3}})\s+(?:means|shall\s+mean)\b"
PRIORITY = ["equidae", "equine animal", "holding", "keeper", "owner", "registered equidae", "equidae for breeding and production", "equidae for slaughter", "competent authority", "transponder", "unique life number", "mark", "smart card", "veterinarian responsible", "official veterinarian", "appropriate authority"]
NOT_OPERATIVE = ["recital", "heading", "table", "unknown", "document"]


def is_definition(text: Column) -> Column:
    """Whether the text gives definitions: by its header, by "shall mean", or by "means" and a quoted term."""
    return text.rlike(DEFINITION_HEADER) | text.rlike(r"(?i)\bshall\s+mean\b") | (text.rlike(r"(?i)\bmeans\b") & text.rlike(QUOTED))


def term_key(term: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(term), "[^a-z0-9]+", " "))


def term_rank(term: Column) -> Column:
    """Place of the first listed term that holds the term or is held by it; 50 behind the list for others."""
    key = term_key(term)
    out = F.when(key == "", len(PRIORITY) + 100)
    for place, listed in enumerate(PRIORITY):
        out = out.when(F.contains(key, F.lit(listed)) | F.contains(F.lit(listed), key), place)
    return out.otherwise(len(PRIORITY) + 50)


def _first_of_key(names: Column) -> Column:
    """Names with a key, the first of each key."""
    keys = F.transform(names, term_key)
    return F.filter(names, lambda x, i: (term_key(x) != "") & (F.array_position(keys, term_key(x)) == i + 1))


def definitions(rows: DataFrame, id_col: str, text: str, limit: int = 4) -> DataFrame:
    """id, ord, term, rank of the defined terms of each text, the first `limit` by rank, then place; names joined by " / ", of those with one term_key() the first."""
    found = rows.filter(is_definition(F.col(text))).select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(text, F.lit(ENTRY), F.lit(1))).alias("ord", "entry"))
    names = F.transform(F.regexp_extract_all("entry", F.lit(QUOTED), F.lit(1)), lambda x: F.trim(x))
    cut = found.select("id", "ord", F.array_join(_first_of_key(names), " / ").alias("term")).withColumn("rank", term_rank(F.col("term")))
    best = cut.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "ord", "term"))), 1, limit).alias("best"))
    return best.select("id", F.inline("best")).select("id", "ord", "term", "rank")


def match_locator(locator: Column) -> Column:
    """A locator in the form in which required ones are compared: no chunk, article numbers without leading zeros."""
    base = F.trim(F.substring_index(F.lower(F.trim(F.coalesce(locator, F.lit("")))), "|chunk:", 1))
    number = F.regexp_extract(base, r"^article:\s*0*(\d+)\s*$", 1)
    return F.when(number != "", F.concat(F.lit("article:"), number)).otherwise(F.regexp_replace(base, r"^(article|annex):\s+", "$1:"))


def select_fragments(fragments: DataFrame, required: list[str] = (), focus: list[str] = (), include_annexes: bool = False, selection: str = "all_matching", least_chars: int = 40, model_mode: bool = True) -> DataFrame:
    """Adds selected and reason by ordered rules; fragments: locator, fragment_type, fragment_text."""
    body = F.lower(F.coalesce("fragment_text", F.lit("")))
    hits = sum((F.contains(body, F.lit(t)).cast("int") for t in focus), F.lit(0))
    phrase = T.any_in(body, [t for t in focus if " " in t]) if any(" " in t for t in focus) else F.lit(False)
    kind = F.coalesce(F.nullif("fragment_type", F.lit("")), F.lit("unknown"))
    required = [r.lower() for r in required]
    reason = F.when(F.lit(not model_mode), "focus_term_match").when(match_locator(F.col("locator")).isin(required) if required else F.lit(False), "required_locator")
    reason = reason.when(F.lit(include_annexes) & (kind == "annex"), "annex_included").when(F.lit(selection == "required_only"), "skipped_not_required_in_required_only_mode")
    reason = reason.when(F.lit(not required and not include_annexes and not focus) | (hits >= 2) | phrase, "focus_term_match").when(F.lit(selection == "required_plus_focus"), "skipped_no_focus_match")
    reason = reason.when(F.length(body) < least_chars, "skipped_too_short").when(kind.isin(NOT_OPERATIVE), "skipped_non_operative").otherwise("skipped_no_focus_match")
    return fragments.withColumn("reason", reason).withColumn("selected", ~F.col("reason").startswith("skipped"))


def comparison_form(text: Column) -> Column:
    return T.squash(F.lower(text))


def _list_items(sources: DataFrame, fragments: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """At most `limit` items of each source's lists, by turns over their letters where there are more; and what is said by them."""
    rows = fragments.withColumn("id", F.struct("source_record_id", "ord"))
    items = structured_items(rows, "id", "fragment_text", "locator", with_intro=True)
    items = items.select(F.col("id.source_record_id").alias("source_record_id"), F.struct(F.col("id.ord").alias("fragment"), F.col("ord").alias("item")).alias("place"), "clause", "intro", F.substring_index("item_locator", ":list:", -1).alias("path"))
    letter = W.partitionBy("source_record_id", F.split_part("path", F.lit("-"), F.lit(2)))
    source = W.partitionBy("source_record_id")
    some = items.withColumn("turn", F.row_number().over(letter.orderBy("place"))).filter(F.col("turn") <= limit)
    some = some.withColumns({"n": F.count(F.lit(1)).over(source), "opens": F.min("place").over(letter)})
    by_turns = F.when(F.col("n") > limit, F.struct("turn", "opens"))
    picked = some.withColumn("seq", F.row_number().over(source.orderBy(by_turns, "place"))).filter(F.col("seq") <= limit)
    base = F.coalesce(F.when(~T.is_placeholder(F.col("locator")), F.col("locator")), T.article_reference(F.col("text")), F.lit("article:unknown"))
    marks = F.array_join(F.slice(F.split("path", "-"), 2, 9), ")->(")
    drawn = picked.join(sources.select("source_record_id", "locator", "text"), "source_record_id").select(
        "source_record_id", "seq", F.left(F.concat(base, F.lit(":list:"), "path"), F.lit(512)).alias("fragment_locator"), F.col("clause").alias("proposition_text"), marks.alias("mark"),
        F.concat_ws(":", T.slug(F.trim("source_record_id")), T.slug(F.col("path")), F.concat(F.lit("p"), F.lpad(F.col("seq").cast("string"), F.greatest(F.lit(3), F.length(F.col("seq").cast("string"))), F.lit("0")))).alias("proposition_key"),
    )
    intros = items.groupBy("source_record_id").agg(F.min_by("intro", "place").alias("said"))
    return drawn, picked.select("source_record_id", F.col("clause").alias("said")).unionByName(intros)


def extract_by_rules(sources: DataFrame, fragments: DataFrame, limit: int) -> DataFrame:
    """Propositions of each source without a model, `limit` at most: items of lettered lists, then sentences.

    sources: source_record_id (one row each, a text), locator, text; fragments: source_record_id, ord, locator, fragment_text.
    Sentences that the items say already are left out. Of the rest, normative ones at operative places are taken, without
    any of these normative ones, else all, else the whole text. Null texts count as empty; a source without any text
    says so in one proposition. Sources without fragments are taken whole.
    """
    items, said = _list_items(sources, fragments, limit)
    pieces = fragments.select("source_record_id", F.col("locator").alias("fragment_locator"), "ord", F.posexplode(T.sentences(F.coalesce("fragment_text", F.lit("")))).alias("pos", "proposition_text"))
    normative = T.is_normative(F.col("proposition_text"))
    tier = F.when(normative & F.coalesce(is_operative_locator(F.col("fragment_locator")), F.lit(False)), 0).when(normative, 1).otherwise(2)
    whole = sources.select(
        "source_record_id", F.coalesce(F.nullif("locator", F.lit("")), F.lit("document:full")).alias("fragment_locator"), F.lit(0).alias("ord"), F.lit(0).alias("pos"),
        F.when(F.col("text").rlike(r"\S"), F.regexp_replace("text", r"^\s+|\s+$", "")).otherwise("No source text provided.").alias("proposition_text"), F.lit(3).alias("tier"),
    )
    key = lambda text: T.content_hash(comparison_form(F.col(text))).alias("form")
    known = said.filter("trim(said) != ''").select("source_record_id", key("said"))
    fresh = pieces.withColumn("tier", tier).unionByName(whole).withColumn("form", key("proposition_text")).join(known, ["source_record_id", "form"], "left_anti")
    ranked = fresh.withColumn("seq", F.row_number().over(W.partitionBy("source_record_id").orderBy("tier", "ord", "pos"))).filter(F.col("seq") <= limit)
    best = ranked.withColumn("best", F.min("tier").over(W.partitionBy("source_record_id"))).filter("tier = best")
    taken = items.groupBy("source_record_id").agg(F.max("seq").alias("before"))
    before = F.coalesce("before", F.lit(0))
    rest = best.join(taken, "source_record_id", "left").filter(F.col("seq") + before <= limit)
    rest = rest.select("source_record_id", (F.col("seq") + before).alias("seq"), "fragment_locator", "proposition_text", F.lit(None).cast("string").alias("mark"), F.lit(None).cast("string").alias("proposition_key"))
    number = F.col("seq").cast("string")
    found = with_fields(items.unionByName(rest)).withColumn("id", F.concat(F.lit("prop-"), T.slug(F.col("source_record_id")), F.lit("-"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0"))))
    reference = F.coalesce("text_reference", T.locator_reference(F.col("fragment_locator")), "mark")
    return found.withColumn("article_reference", reference).drop("text_reference", "mark", "normative")

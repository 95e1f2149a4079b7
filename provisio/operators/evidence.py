"""Evidence of scopes in propositions: where a term stands, how much that place says, and when it speaks of other species.

Texts are tokenised once; only tokens that begin a term are taken further, and meet the terms in a hash join. The texts of a
source are searched once for each source, however many propositions it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scopes import closure

# Fields by the rank of their evidence, with relevance and confidence; distances in characters; phrases.
FIELDS = [
    ("proposition_text", "direct", "high"), ("legal_subject", "direct", "high"), ("affected_subjects", "direct", "high"),
    ("required_documents", "direct", "high"), ("conditions", "direct", "high"), ("source_fragment_text", "direct", "high"),
    ("source_citation", "contextual", "medium"), ("source_title", "contextual", "medium"), ("proposition_label", "contextual", "medium"),
    ("source_context", "contextual", "low"),
]
NEAR_ANCHOR, EXCERPT_RADIUS, LOOKBACK, BODY_CHARS = 250, 100, 360, 8000
ANCHOR_WORD, ANCHOR_PREFIXES = 5, (96, 72, 48, 32, 24, 16, 12)
CROSS_REFERENCE = r"\bother than those referred to in points\b|\bspecies other than those referred to\b|\banimal species other than those referred to\b|\bspecies other than\b"
EXCLUSION = r"\bother than\b|\bthan those referred to in points\b|\b(excluding|with the exception of)\b"
#: Scopes whose hits are downgraded in exclusions, with the phrases that make a proposition one about them all the same.
SUBJECTS = {"equine": r"\b(kept animals of the equine species|animals of the equine species|operators of kept animals of the equine species|the equine species|equidae|equus|horses?)\b"}
#: Terms of a taxonomy, at most; their first words are a constant of the plan.
MAX_TERMS = 10_000
#: Fields in the order in which a term is looked for; the body is fragment text or context.
_LOOKED_AT = ["proposition_text", "legal_subject", "affected_subjects", "required_documents", "conditions", "body", "source_citation", "source_title", "proposition_label"]
_RANK = {name: k for k, (name, _, _) in enumerate(FIELDS)}


def normal(text: Column) -> Column:
    """Lower case with white space squashed; null as the empty text."""
    return F.coalesce(T.squash(F.lower(text)), F.lit(""))


def match_terms(scopes: DataFrame) -> DataFrame:
    """scope_id, term, place (from 0, the longest first), first (its first word), pattern of the active scopes.

    Terms are the slug in words, each of these words, the label and the synonyms, each once. Terms of one word are whole
    words; terms of several begin with a word, and their last word may go on, as in the plural.
    """
    words = F.trim(F.replace("slug", F.lit("_"), F.lit(" ")))
    given = F.concat(F.array(words), F.split(words, r"\s+"), F.array(F.lower("label")), F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: F.lower(s)))
    distinct = F.filter(F.array_distinct(F.transform(given, lambda t: F.trim(F.coalesce(t, F.lit(""))))), lambda t: t != "")
    longest = F.array_sort(F.transform(distinct, lambda t, i: F.struct((-F.length(t)).alias("less"), i.alias("i"), t.alias("term"))))
    terms = scopes.filter("status = 'active'").select("scope_id", F.posexplode(longest).alias("place", "t")).select("scope_id", "place", F.col("t.term").alias("term"))
    quoted = F.concat(F.lit(r"(?U)\b\Q"), "term", F.lit(r"\E"), F.when(F.contains("term", F.lit(" ")), "").otherwise(r"\b"))
    return terms.withColumns({"first": F.regexp_extract("term", r"(?U)\w+", 0), "pattern": quoted})


def term_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """texts (with a normalised column `text`) with scope_id, term, place, start, stop of each term's first match."""
    firsts = sorted(r.first for r in terms.select("first").distinct().limit(MAX_TERMS + 1).collect())
    if len(firsts) > MAX_TERMS:
        raise ValueError(f"a taxonomy has {MAX_TERMS} first words at most")
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)))
    begun = texts.filter("text <> ''").withColumn("first", F.explode(F.array_intersect(tokens, F.array(*map(F.lit, firsts)).cast("array<string>"))))
    found = begun.join(F.broadcast(terms), "first").withColumn("start", F.regexp_instr("text", F.col("pattern")) - 1)
    return found.filter("start >= 0").withColumn("stop", F.col("start") + F.length("term")).drop("first", "pattern")


def excerpt(text: Column, start: Column, stop: Column, radius: int = EXCERPT_RADIUS) -> Column:
    """The place with so many characters on either side, with an ellipsis where text is left out."""
    low, high = F.greatest(F.lit(0), start - radius), F.least(F.length(text), stop + radius)
    cut = F.trim(F.substring(text, low + 1, high - low))
    return F.concat(F.when(low > 0, "…").otherwise(""), cut, F.when(high < F.length(text), "…").otherwise(""))


def in_exclusion(text: Column, start: Column) -> Column:
    """Whether the text before the place speaks of an exclusion."""
    low = F.greatest(F.lit(0), start - LOOKBACK)
    return F.substring(text, low + 1, start - low).rlike(EXCLUSION)


def anchor(proposition: Column, body: Column) -> Column:
    """About where in the body the proposition stands: at its longest word that is found there, else at its beginning."""
    words = F.filter(F.split(proposition, " "), lambda w: F.length(w) >= ANCHOR_WORD)
    longest = F.transform(F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("less"), i.alias("i"), w.alias("word")))), lambda s: s["word"])
    at = lambda w: F.when(F.contains(body, w), F.regexp_instr(body, F.concat(F.lit(r"(?U)\b\Q"), w, F.lit(r"\E\b")))).otherwise(0)
    spots = F.filter(F.transform(longest, lambda w: F.struct(at(w).alias("at"), F.length(w).alias("size"))), lambda s: s["at"] > 0)
    middle = F.floor((2 * (spots[0]["at"] - 1) + spots[0]["size"]) / 2)
    prefixes = [F.when((F.length(proposition) >= n) & F.contains(body, F.substring(proposition, 1, n)), F.instr(body, F.substring(proposition, 1, n)) - 1 + n // 2) for n in ANCHOR_PREFIXES]
    return F.coalesce(F.when(F.size(spots) > 0, middle), *prefixes, F.floor(F.length(body) / 2)).cast("int")


def _fields(props: DataFrame) -> Column:
    """The fields of a proposition that can hold a term: where it is looked at, name, normalised text."""
    flat = lambda c: F.array_join(c, " ") if props.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    label = [flat(c) for c in ("label", "short_name", "categories", "tags") if c in props.columns]
    texts = {name: flat(name) for name in _LOOKED_AT[:5] if name in props.columns} | ({"proposition_label": F.concat_ws(" ", *label)} if label else {})
    return F.array(*(F.struct(F.lit(_LOOKED_AT.index(name)).alias("look"), F.lit(name).alias("field"), normal(text).alias("text")) for name, text in texts.items()))


def scope_evidence(props: DataFrame, sources: DataFrame, scopes: DataFrame) -> DataFrame:
    """The best evidence of each active scope in each proposition: link_id, id, scope_id, term, field, relevance, confidence,
    excerpt, species_exclusion.

    props: id, source_record_id, proposition_text and, as far as there are, legal_subject, affected_subjects,
    required_documents, conditions, label, short_name, categories, tags. sources: id, title, citation, authoritative_text, of
    which the first 8,000 characters are read. scopes: scope_id, slug, label, synonyms, status. A term counts in the
    first field that holds it: a match near the place where the proposition stands in the body is fragment text, another one
    context. Of a scope's terms the one with the strongest field counts, then the longest. Propositions without a source are
    judged by themselves; null fields hold nothing.
    """
    terms = match_terms(scopes)
    own = props.select("id", normal(F.col("proposition_text")).alias("said"), F.explode(_fields(props)).alias("f")).select("id", "said", "f.look", "f.field", "f.text")
    found = ["id", "said", "scope_id", "term", "place", "look", "field", "excerpt", "excluded"]
    looked_back = F.col("field").isin("proposition_text", "proposition_label", "body")
    seen = {"excerpt": excerpt(F.col("text"), F.col("start"), F.col("stop")), "excluded": looked_back & in_exclusion(F.col("text"), F.col("start"))}
    direct = term_hits(own, terms).withColumns(seen).select(found)
    body = normal(F.substring("authoritative_text", 1, BODY_CHARS))
    parts = {"body": body, "source_citation": normal(F.col("citation")), "source_title": normal(F.col("title"))}
    texts = sources.select(F.col("id").alias("source_record_id"), F.explode(F.array(*(F.struct(F.lit(_LOOKED_AT.index(n)).alias("look"), F.lit(n).alias("field"), t.alias("text")) for n, t in parts.items()))).alias("f")).select("source_record_id", "f.*")
    hit = F.struct("scope_id", "term", "place", "look", "field", ((F.col("start") + F.col("stop")) / 2).alias("middle"), "excerpt", "excluded")
    # One row for each source with all its hits, so that the join leaves one row for each proposition.
    by_source = term_hits(texts, terms).withColumns(seen).groupBy("source_record_id").agg(F.collect_list(hit).alias("hits"), F.max(F.when(F.col("field") == "body", F.col("text"))).alias("body"))
    met = props.select("id", "source_record_id", normal(F.col("proposition_text")).alias("said")).join(by_source, "source_record_id")
    met = met.withColumn("anchor", F.when(F.col("body").isNotNull(), anchor(F.col("said"), F.col("body")))).select("id", "said", "anchor", F.explode("hits").alias("h")).select("id", "said", "anchor", "h.*")
    near = F.when(F.col("field") != "body", F.col("field")).when(F.abs(F.col("middle") - F.col("anchor")) <= NEAR_ANCHOR, "source_fragment_text").otherwise("source_context")
    every = direct.unionByName(met.withColumn("field", near).select(found)).repartition("id", "scope_id")
    # Both groupings keep to the deal by id and scope, so this is the only shuffle.
    first = every.groupBy("id", "scope_id", "term").agg(F.min_by(F.struct("said", "place", "field", "excerpt", "excluded"), "look").alias("h"))
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in _RANK.items() for x in kv)), F.col("h.field"))
    best = first.groupBy("id", "scope_id").agg(F.min_by(F.struct("term", "h.*"), F.struct(rank, "h.place")).alias("h")).select("id", "scope_id", "h.*")
    return _judged(best)


def _judged(best: DataFrame) -> DataFrame:
    """Relevance and confidence by the field; scopes named in an exclusion or a cross reference to other species fall back."""
    by_field = lambda i: F.element_at(F.create_map(*(F.lit(x) for f in FIELDS for x in (f[0], f[i]))), F.col("field"))
    about = F.lit(False)
    for scope, pattern in SUBJECTS.items():
        about |= (F.col("scope_id") == scope) & ~F.col("said").rlike(pattern)
    cross = F.col("said").rlike(CROSS_REFERENCE)
    rows = best.withColumns({"relevance": by_field(1), "confidence": by_field(2), "cross": about & cross, "species_exclusion": about & (cross | F.col("excluded"))})
    fallen = F.col("species_exclusion") & ~((F.col("relevance") == "contextual") & (F.col("confidence") == "low"))
    rows = rows.withColumns({"species_exclusion": fallen | F.col("cross"), "relevance": F.when(fallen, "contextual").otherwise(F.col("relevance")), "confidence": F.when(fallen, "medium").otherwise(F.col("confidence"))})
    return rows.select(link_id(F.lit("explicit"), F.col("term")).alias("link_id"), "id", "scope_id", "term", "field", "relevance", "confidence", "excerpt", "species_exclusion")


def link_id(inheritance: Column, basis: Column) -> Column:
    """The id of a link of `id` with `scope_id`."""
    return F.concat(F.lit("psl:"), T.short_hash(F.concat_ws("|", "id", "scope_id", inheritance, basis)))


def inherited_evidence(links: DataFrame, scopes: DataFrame) -> DataFrame:
    """Links with the scopes above those of explicit links: link_id, id, scope_id, narrower, confidence, from_weak.

    An explicit link with the scope itself wins. Of several narrower scopes the one with the strongest confidence
    counts, then the nearest, then the first by name; a low one makes a low link.
    """
    up = closure(scopes, "scope_id", "parent_scope_id").filter("depth > 0").select(F.col("descendant").alias("scope_id"), "ancestor", "depth")
    below = links.join(F.broadcast(up), "scope_id").select("id", F.col("ancestor").alias("scope_id"), F.struct(F.col("confidence") == "low", "depth", "scope_id").alias("child"))
    above = below.groupBy("id", "scope_id").agg(F.min("child").alias("child")).join(links.select("id", "scope_id"), ["id", "scope_id"], "left_anti")
    weak = F.col("child.col1")
    rows = above.select("id", "scope_id", F.col("child.scope_id").alias("narrower"), F.when(weak, "low").otherwise("medium").alias("confidence"), weak.alias("from_weak"))
    return rows.select(link_id(F.lit("inherited"), F.col("narrower")).alias("link_id"), "*")


def review_candidates(links: DataFrame, above: DataFrame, scopes: DataFrame, run_id: str) -> DataFrame:
    """What a reviewer should look at: candidate_id, id, scope_id, kind, related, snippets.

    Links by low source context alone, several sibling species in one proposition, and links inherited from a weak one.
    """
    weak = links.filter("field = 'source_context' AND confidence = 'low'").select("id", "scope_id", F.lit("weak_source_context_only").alias("kind"), F.array().cast("array<string>").alias("related"), F.array("excerpt").alias("snippets"))
    species = scopes.filter("scope_type = 'species' AND parent_scope_id <> ''").select("scope_id", "parent_scope_id")
    # As many siblings as a scope has children, at most.
    together = links.join(F.broadcast(species), "scope_id").groupBy("id", "parent_scope_id").agg(F.sort_array(F.collect_list(F.struct("scope_id", "excerpt"))).alias("s")).filter(F.size("s") > 1)
    siblings = together.select("id", F.col("s")[0]["scope_id"].alias("scope_id"), F.lit("sibling_species_ambiguity").alias("kind"), F.col("s.scope_id").alias("related"), F.col("s.excerpt").alias("snippets"))
    handed = above.filter("from_weak").select("id", "scope_id", F.lit("inherited_from_weak_child").alias("kind"), F.array("narrower", "scope_id").alias("related"), F.array(F.concat(F.lit("narrower_scope:"), "narrower")).alias("snippets"))
    rows = weak.unionByName(siblings).unionByName(handed)
    basis = F.concat(F.lit(run_id), F.lit("|"), F.concat_ws("|", "id", "scope_id", "kind"), F.lit("|"), F.array_join("related", "|"))
    return rows.select(F.concat(F.lit("lscr:"), T.short_hash(basis)).alias("candidate_id"), "*")


def unknown_scope_candidates(tags: DataFrame, scopes: DataFrame, run_id: str, reason: str) -> DataFrame:
    """A review candidate for each suggested slug that is no scope: candidate_id, suggested_slug, n (rows), first_id. tags: id, tag."""
    slug = F.regexp_replace(normal(F.col("tag")), r"[^a-z0-9]+", "_")
    asked = tags.select("id", slug.alias("suggested_slug")).filter("suggested_slug <> ''").join(scopes.select(F.col("slug").alias("suggested_slug")), "suggested_slug", "left_anti")
    found = asked.groupBy("suggested_slug").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    basis = F.concat_ws("|", F.lit(run_id), "suggested_slug", F.lit(reason))
    return found.select(F.concat(F.lit("lscr:"), T.short_hash(basis)).alias("candidate_id"), "suggested_slug", "n", "first_id")

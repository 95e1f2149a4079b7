"""Candidates of a source family: what they repeat in the registry, whether they can be registered, and what becomes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Series of the legislation site, words that titles don't count, scores, and phrases of conceptual groups.
AUTHORITY, SITE = "legislation_gov_uk", "legislation.gov.uk"
SERIES = ["eur", "ukpga", "uksi", "asc", "wsi", "ssi", "nia", "nisr", "asp", "anaw"]
STOP = ["the", "a", "an", "of", "and", "or", "for", "to", "in", "on", "no", "eu", "uk"]
SCORES = {"celex": 50, "citation": 40, "authority_source_id": 60, "url": 45}
CLOSE, TITLE_POINTS, LONG_TITLE, LONG_CITATION, KEY_SCORE, TITLE_SCORE = 0.72, 20, 14, 6, 40, 18
CONCEPTUAL = r"(?i)\b(source family|instrument family|conceptual grouping|legal framework|regulatory family|parent act|umbrella (regulation|directive))\b"


def _t(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")), F.lit(""))


def celex(column: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(column, F.lit("")), r"[\s/._-]+", ""))


def citation_key(column: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), "[–—]", "-"), r"(?U)\s+", " "))


def url_key(column: Column) -> Column:
    """Host and path in lower case, without the name of the data file and slashes at the end; other texts in lower case."""
    raw = F.trim(F.coalesce(column, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)), r"/data\.xml$", ""), "/+$", "")
    return F.when(bare != "", bare).otherwise(F.lower(raw))


def site_id() -> Column:
    """The identifier on the legislation site, from the address or the candidate's own id, of three parts at least; else null."""
    url, own = _t("url"), _t("candidate_source_id")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    steps = lambda text: F.filter(F.split(text, "/"), lambda s: s != "")
    parts = F.filter(steps(path), lambda s: F.lower(s) != "data.xml")
    from_url = F.when(F.contains(F.lower(url), F.lit(SITE)) & (F.size(parts) >= 3), F.lower(F.array_join(parts, "/")))
    return F.coalesce(from_url, F.when(F.size(steps(own)) >= 3, F.lower(F.btrim(own, F.lit("/")))))


def authority() -> Column:
    """The stated authority, else the legislation site where address or id point to it, else null."""
    series = F.lower(F.split(_t("candidate_source_id"), "/")[0]).isin(SERIES) & F.contains(_t("candidate_source_id"), F.lit("/"))
    return F.coalesce(F.when(_t("authority") != "", _t("authority")), F.when(F.contains(F.lower(_t("url")), F.lit(SITE)) | series, AUTHORITY))


def has_locator() -> Column:
    """An address, or an authority with a citation, CELEX number or ELI."""
    return (_t("url") != "") | (authority().isNotNull() & ((_t("citation") != "") | (_t("celex") != "") | (_t("eli") != "")))


def block_reason() -> Column:
    """Why a candidate can't be registered without review, the first reason; empty where it can."""
    unknown = lambda c: F.lower(_t(c)).isin("", "unknown")
    return (
        F.when(_t("title") == "", "missing title").when(unknown("source_role"), "source_role required (not unknown)").when(unknown("relationship_to_target"), "relationship_to_target required (not unknown)")
        .when(~has_locator(), "need url or authority with citation/celex/eli").when(site_id().isNull(), "cannot auto-register (manual review needed)").otherwise("")
    )


def with_reference(candidates: DataFrame) -> DataFrame:
    """Candidates with what the registry would hold of them: reference_id, reference_url, jurisdiction, reference_citation, reason."""
    rows = candidates.withColumns({"site_id": site_id(), "reason": block_reason()})
    place = F.when(F.split("site_id", "/")[0].isin([s for s in SERIES if s != "eur"]), "UK").otherwise("EU")
    shown = lambda c: F.when(F.col("site_id").isNotNull(), c)
    cited = F.coalesce(F.when(_t("citation") != "", _t("citation")), F.when(_t("celex") != "", _t("celex")), F.col("site_id"))
    return rows.withColumns({"reference_id": shown(F.concat(F.lit("src-"), T.slug(F.col("site_id")))), "reference_url": shown(F.concat(F.lit(f"https://www.{SITE}/"), "site_id", F.lit("/data.xml"))), "jurisdiction": shown(place), "reference_citation": shown(cited)})


def register(asked: DataFrame, candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """What becomes of each candidate asked for: candidate_id, outcome, detail.

    asked: ord, candidate_id; candidates: id and its fields; registry: registry_id, authority, authority_source_id.
    outcome: registered or already_registered (detail: the registry id), manual_review_needed (the reason), error. Of
    several candidates with one identifier the first asked for is registered. Blank ids go; one asked for twice is
    answered twice.
    """
    wanted = asked.withColumn("candidate_id", _t("candidate_id")).filter("candidate_id <> ''")
    known = with_reference(candidates).withColumn("candidate_id", _t("id")).groupBy("candidate_id").agg(F.first(F.struct("site_id", "reason")).alias("c"))
    held = registry.filter(F.lower(_t("authority")) == AUTHORITY).select(F.lower(F.btrim(_t("authority_source_id"), F.lit("/"))).alias("site_id"), "registry_id").groupBy("site_id").agg(F.min("registry_id").alias("held"))
    rows = wanted.join(known, "candidate_id", "left").select("ord", "candidate_id", F.col("c.site_id").alias("site_id"), F.col("c.reason").alias("reason")).join(held, "site_id", "left")
    # The first to be registered under an identifier: aggregated, so that a very common one is no single task's.
    first = rows.filter("reason = '' AND held IS NULL").groupBy("site_id").agg(F.min(F.struct("ord", "candidate_id")).alias("first"))
    rows = rows.join(first, "site_id", "left")
    fresh = F.concat(F.lit("reg-"), T.slug(F.concat(F.lit(f"{AUTHORITY}-"), "site_id")))
    outcome = F.when(F.col("reason").isNull(), "error").when(F.col("reason") != "", "manual_review_needed").when(F.col("held").isNotNull() | (F.struct("ord", "candidate_id") != F.col("first")), "already_registered").otherwise("registered")
    detail = F.when(F.col("reason").isNull(), "candidate_id not found for target").when(F.col("reason") != "", F.col("reason")).otherwise(F.coalesce("held", fresh))
    return rows.select("ord", "candidate_id", outcome.alias("outcome"), detail.alias("detail"))


def profile_members(profiles: DataFrame, instruments: DataFrame, profile: str) -> DataFrame:
    """The instruments of a profile in its order: place and the columns of instruments (instrument_id, …); an unknown profile is an error."""
    chosen = profiles.filter(F.col("profile_id") == profile)
    if not chosen.take(1):
        raise ValueError(f"unknown profile {profile!r}")
    ids = chosen.select(F.posexplode("member_ids").alias("place", "instrument_id"))
    return ids.join(instruments, "instrument_id", "left")


# --- duplicates --------------------------------------------------------------------------------------------------------
def title_words(title: Column) -> Column:
    """The distinct words of a title that count, sorted."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP))))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared words over all words."""
    return F.when(F.size(a) + F.size(b) > 0, 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def _signatures(sets: DataFrame, ranks: DataFrame, least: float) -> DataFrame:
    """words, signature: pairs of the rarest words of each set, two of which any two sets that are close enough share.

    Sets at or above `least` share o = least / (2 - least) of either's words, hence two of its |set| - o + 2 rarest ones.
    A set of a single word is its own signature.
    """
    ranked = sets.select("words", F.explode("words").alias("word")).join(ranks, "word").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("r"))
    rare = F.transform("r", lambda x: x["word"])
    need = F.ceil(F.size("words") * least / (2 - least) - 1e-9)
    rare = F.slice(rare, 1, F.least(F.size("words"), F.size("words") - need + 2).cast("int"))
    numbered = F.transform(rare, lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    pairs = F.flatten(F.transform(numbered, lambda a: F.transform(F.filter(numbered, lambda b: b["i"] > a["i"]), lambda b: F.array_join(F.array_sort(F.array(a["w"], b["w"])), " "))))
    return ranked.select("words", F.explode(F.when(F.size("words") == 1, F.col("words")).otherwise(pairs)).alias("signature"))


def close_sets(left: DataFrame, right: DataFrame, least: float = CLOSE) -> DataFrame:
    """left_words, right_words, similarity of all pairs of word sets with a Dice coefficient of at least `least`.

    left and right hold distinct sets (`words`), so copies of a title meet once. Pairs meet on signatures of their rarest words.
    """
    every = left.select("words").unionByName(right.select("words"))
    ranks = every.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    a, b = (_signatures(s.filter(F.size("words") > 0), ranks, least).withColumnRenamed("words", f"{n}_words") for s, n in ((left, "left"), (right, "right")))
    size_a, size_b = F.size("left_words"), F.size("right_words")
    fits = F.least(size_a, size_b) * 2 >= least * (size_a + size_b) - 1e-9
    met = a.join(b, "signature").filter(fits).select("left_words", "right_words").distinct()
    return met.withColumn("similarity", dice(F.col("left_words"), F.col("right_words"))).filter(F.col("similarity") >= least)


def duplicates(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry entry that each candidate repeats: id, entry_id, score, similarity, matched_by.

    candidates: id, title, citation, celex, url, candidate_source_id; registry: entry_id, title, citation, celex, url,
    authority_source_id. Equal keys and close titles add up; the highest score wins, then the smallest entry_id. It counts
    with a score of 40 and a key, or of 18 and a close title. Blank keys are no keys. Keys meet in equi-joins, titles by
    their rarest words.
    """
    c = candidates.select("id", "title", celex(F.col("celex")).alias("celex"), citation_key(F.col("citation")).alias("citation"), F.coalesce(site_id(), F.lit("")).alias("authority_source_id"), url_key(F.col("url")).alias("url"), title_words(F.col("title")).alias("words"))
    r = registry.select("entry_id", "title", celex(F.col("celex")).alias("celex"), citation_key(F.col("citation")).alias("citation"), F.lower(_t("authority_source_id")).alias("authority_source_id"), url_key(F.col("url")).alias("url"), title_words(F.col("title")).alias("words"))
    long = F.length(F.trim("title")) > LONG_TITLE
    counts = lambda k, side: (F.length(side) > LONG_CITATION) if k == "citation" else (side != "")
    by_key = None
    for key in SCORES:
        met = c.filter(counts(key, F.col(key))).select("id", key).join(r.filter(F.col(key) != "").select("entry_id", key), key).select("id", "entry_id")
        by_key = met if by_key is None else by_key.unionByName(met)
    # Pairs with an equal key are scored whole; of those with a close title alone only the first entry of a word set can win.
    ca, rb = (df.select(n, F.struct(F.length(F.trim("title")).alias("chars"), *SCORES, "words").alias(s)) for df, n, s in ((c, "id", "a"), (r, "entry_id", "b")))
    pairs = by_key.distinct().join(ca, "id").join(rb, "entry_id")
    close = dice(F.col("a.words"), F.col("b.words"))
    titled = (close >= CLOSE) & (F.col("a.chars") > LONG_TITLE) & (F.col("b.chars") > LONG_TITLE)
    equal = {k: (F.col(f"a.{k}") == F.col(f"b.{k}")) & counts(k, F.col(f"a.{k}")) for k in SCORES}
    points = sum((F.when(e, SCORES[k]).otherwise(0) for k, e in equal.items()), F.when(titled, F.floor(close * TITLE_POINTS + 0.5)).otherwise(0))
    how = F.array_compact(F.array(*(F.when(e, k) for k, e in equal.items()), F.when(titled, "title_similarity")))
    whole = pairs.select("id", "entry_id", points.cast("int").alias("score"), F.round(close, 6).alias("similarity"), F.array_join(how, "|").alias("matched_by"))
    firsts = r.filter(long).groupBy(F.col("words").alias("right_words")).agg(F.min("entry_id").alias("entry_id"))
    near = close_sets(c.filter(long).select("words").distinct(), firsts.select(F.col("right_words").alias("words")))
    scored = near.join(firsts, "right_words").withColumn("score", F.floor(F.col("similarity") * TITLE_POINTS + 0.5).cast("int"))
    best_set = scored.groupBy("left_words").agg(F.max_by(F.struct("entry_id", "score", "similarity"), F.struct(F.col("score"), -F.col("entry_id"))).alias("t"))
    by_title = c.filter(long).select("id", F.col("words").alias("left_words")).join(best_set, "left_words").select("id", "t.entry_id", "t.score", F.round("t.similarity", 6).alias("similarity"), F.lit("title_similarity").alias("matched_by"))
    best = whole.unionByName(by_title).filter("score > 0").groupBy("id").agg(F.max_by(F.struct("entry_id", "score", "similarity", "matched_by"), F.struct(F.col("score"), -F.col("entry_id"), F.length("matched_by"))).alias("m")).select("id", "m.*")
    by_other = F.col("matched_by") != "title_similarity"
    return best.filter((by_other & (F.col("score") >= KEY_SCORE)) | (F.contains("matched_by", F.lit("title_similarity")) & (F.col("score") >= TITLE_SCORE)))


def classify(candidates: DataFrame, registry: DataFrame, decisions: DataFrame, session: DataFrame) -> DataFrame:
    """The state of each candidate: id, state, registry_id, block_reasons.

    registry as in duplicates(), with authority and registry_id; decisions: id, decision, existing_registry_id; session: id,
    registry_id (registered just now). In this order: ignored, already_registered, needs_source_selection (conceptual
    groups, and those covered by an existing source), possible_duplicate, context_only, needs_source_selection, ready_to_register.
    """
    rows = with_reference(candidates)
    held = registry.filter(F.lower(_t("authority")) == AUTHORITY).select(F.lower(_t("authority_source_id")).alias("site_id"), "registry_id").groupBy("site_id").agg(F.max("registry_id").alias("__held"))
    names = registry.select("entry_id", F.col("registry_id").alias("__duplicate"))
    twins = duplicates(candidates, registry).select("id", "entry_id").join(names, "entry_id").select("id", "__duplicate")
    said = decisions.groupBy("id").agg(F.max(F.struct("decision", _t("existing_registry_id").alias("rid"))).alias("__said"))
    now = session.groupBy("id").agg(F.max(F.when(_t("registry_id") != "", _t("registry_id"))).alias("__now"))
    rows = rows.join(held, "site_id", "left").join(twins, "id", "left").join(said, "id", "left").join(now, "id", "left")
    covered = F.when((F.col("__said.decision") == "covered_by_existing") & (F.col("__said.rid") != ""), F.col("__said.rid"))
    twin = F.when(~F.col("__duplicate").eqNullSafe(covered), F.col("__duplicate"))
    conceptual = F.coalesce(F.col("conceptual"), F.lit(False)) | F.coalesce(F.col("title"), F.lit("")).rlike(CONCEPTUAL)
    existing, ready = F.coalesce("__now", "__held"), F.col("reason") == ""
    unknown = lambda c: F.lower(_t(c)).isin("", "unknown")
    blocks = F.array_compact(F.array(
        F.when(conceptual, "conceptual_grouping_only"), F.when(_t("title") == "", "missing_title"), F.when(unknown("source_role") | unknown("relationship_to_target"), "unknown_source_role_or_relationship"),
        F.when(~has_locator(), "insufficient_citation_celex_eli").when(authority().isNull(), "ambiguous_authority_source"), F.when((_t("url") == "") & F.col("site_id").isNull(), "missing_fetchable_url"),
    ))
    state = (
        F.when(F.col("__said.decision") == "ignored", "ignored").when(existing.isNotNull(), "already_registered").when(conceptual | covered.isNotNull(), "needs_source_selection").when(twin.isNotNull(), "possible_duplicate")
        .when((F.col("inclusion_status") == "optional_context") & ~ready, "context_only").when(~ready, "needs_source_selection").otherwise("ready_to_register")
    )
    found = F.when(F.col("state") == "already_registered", existing).when((F.col("state") == "needs_source_selection") & ~conceptual & covered.isNotNull(), covered).when(F.col("state") == "possible_duplicate", twin)
    listed = F.when(F.col("state") == "possible_duplicate", F.array(F.lit("possible_duplicate_of_existing"))).when((F.col("state") == "context_only") | ((F.col("state") == "needs_source_selection") & (conceptual | covered.isNull())), blocks).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("state", state).select("id", "state", found.alias("registry_id"), F.array_join(listed, "|").alias("block_reasons"))

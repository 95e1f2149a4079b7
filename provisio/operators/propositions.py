"""From sentences to propositions: fields, identity, categories, completeness, divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import locators as L
from ..functions import text as T

# Fixed values of the completeness rules.
OPERATIVE = r"(?i)\b(shall|must|should|may|required to|prohibited|obliged|establish(?:es)?|maintaining|maintain|ensure[sd]?|applies|apply|responsible|entitled|powers?|obligations?|requirements?)\b"
LIST_START = r"(?i)^(\(?[a-z]\)|\(?[ivxlcdm]+\)|\d+[\).])\s+"
OPENERS = [("this regulation", "instrument_identity"), ("this directive", "instrument_identity"), ("this decision", "instrument_identity"), ("this article", "article_locator"), ("this paragraph", "article_locator"), ("that database", "object"), ("those animals", "object"), ("these measures", "object")]
ANCHORS = ["article", "annex", "regulation", "directive", "§"]


def with_fields(props: DataFrame, text: str = "proposition_text") -> DataFrame:
    """Subject, action, conditions, authority, documents and whether the text is normative."""
    c = F.col(text)
    return props.withColumns({
        "legal_subject": T.subject(c), "action": T.action(c), "conditions": T.conditions(c), "authority": T.authority(c),
        "required_documents": T.documents(c), "normative": T.is_normative(c), "text_reference": T.article_reference(c),
    })


def with_categories(props: DataFrame) -> DataFrame:
    """Sorted categories and tags of propositions with fields."""
    low = F.lower("proposition_text")
    holds = lambda *w: T.any_in(low, list(w))
    rules = [(F.lit(True), "obligation"), (F.col("authority").isNotNull(), "institutional"), (F.size("required_documents") > 0, "documentary"), (F.size("conditions") > 0, "conditional"), (holds("inspect"), "oversight"), (holds("record", "register"), "record_keeping"), (holds("submit", "return"), "reporting")]
    tags = F.array(F.when(F.col("authority").isNotNull(), T.slug(F.col("authority"))), T.slug(F.col("legal_subject")), T.slug(F.col("jurisdiction")))
    return props.withColumns({"categories": F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in rules)))), "tags": F.array_sort(F.array_distinct(F.array_compact(tags)))})


def sequence_token(id_: Column) -> Column:
    found = F.regexp_extract(id_, r"(\d+)$", 1)
    return F.when(found == "", "000").otherwise(found)


def with_identity(props: DataFrame, run_id: str) -> DataFrame:
    """Opaque id, stable key, version id, cross-reference key and the names shown for a proposition."""
    seq = sequence_token(F.col("id"))
    anchor = F.coalesce(T.blank_to_null(F.col("fragment_locator")), T.blank_to_null(F.col("article_reference")), F.col("source_fragment_id"), F.lit(""))
    return props.withColumns({
        "machine_id": F.concat(F.lit("prop:"), T.short_hash(F.concat_ws("\0", "source_record_id", anchor, seq))),
        "proposition_key": key_of(seq),
        "cross_reference_key": F.concat_ws(":", T.slug(F.col("jurisdiction")), T.slug(F.col("legal_subject")), T.slug(F.left(F.when(F.col("action") == "", F.col("proposition_text")).otherwise(F.col("action")), F.lit(60)))),
        "trace_id": F.concat(F.lit("extract-trace:"), T.short_hash(F.concat(F.lit("proposition_extraction_trace|"), F.col("id")))),
        "short_name": F.concat_ws(" ", T.blank_to_null(F.col("legal_subject")), T.blank_to_null(F.col("action"))),
    }).withColumns({
        "proposition_version_id": F.concat_ws(":", F.lit("pver"), "proposition_key", T.slug(F.col("source_snapshot_id")), T.slug(F.lit(run_id))),
        "label": F.concat(L.display_segment(F.col("fragment_locator"), F.col("article_reference")), F.lit(f" {T.DASH} "), F.col("short_name")),
    }).withColumn("slug", F.left(T.slug(F.col("label")), F.lit(96)))


def key_of(seq: Column) -> Column:
    number = F.greatest(F.lit(1), seq.cast("long")).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    segment = L.key_segment(F.col("fragment_locator"), F.col("article_reference"), F.col("source_fragment_id"), F.col("source_record_id"))
    return F.concat(T.slug(F.col("source_record_id")), F.lit(":"), segment, F.lit(":p"), padded)


def inventory(props: DataFrame) -> DataFrame:
    """(kind, key, n) of the inverted indexes by jurisdiction, category, tag, cross reference and lineage."""
    entries = F.concat(
        F.array(F.struct(F.lit("jurisdiction").alias("kind"), F.col("jurisdiction").alias("key"))), F.transform("categories", lambda c: F.struct(F.lit("category").alias("kind"), c.alias("key"))),
        F.transform("tags", lambda c: F.struct(F.lit("tag").alias("kind"), c.alias("key"))), F.array(F.struct(F.lit("cross_reference").alias("kind"), F.col("cross_reference_key").alias("key"))),
        F.array(F.struct(F.lit("lineage").alias("kind"), F.col("proposition_key").alias("key"))),
    )
    return props.select(F.inline(entries)).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


def cross_references(props: DataFrame) -> DataFrame:
    """For each proposition how many others share its cross-reference key, and the first of them by id."""
    keyed = props.select("id", "cross_reference_key")
    low = keyed.groupBy("cross_reference_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lowest"))
    second = keyed.join(low, "cross_reference_key").filter("id <> lowest").groupBy("cross_reference_key").agg(F.min("id").alias("second"))
    joined = keyed.join(low, "cross_reference_key").join(second, "cross_reference_key", "left")
    return joined.select("id", "cross_reference_key", (F.col("n") - 1).alias("targets"), F.when(F.col("id") == F.col("lowest"), F.col("second")).otherwise(F.col("lowest")).alias("first_target"))


def completeness(props: DataFrame, sources: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Whether each proposition can be read by itself: complete, context_dependent or fragmentary.

    sources: source_record_id, citation, title; parents: id, parent_context of the extraction trace, one row an id.
    """
    rows = props.join(sources.select("source_record_id", F.coalesce(T.blank_to_null(F.col("citation")), T.blank_to_null(F.col("title"))).alias("instrument")), "source_record_id", "left")
    rows = rows.join(parents, "id", "left") if parents is not None else rows.withColumn("parent_context", F.lit(None).cast("string"))
    t, low = F.trim("proposition_text"), F.lower(F.trim("proposition_text"))
    operative, parent = t.rlike(OPERATIVE), T.blank_to_null(F.col("parent_context")).isNotNull()
    listed = F.lower("fragment_locator").contains(":list:")
    opener = F.when(low.startswith(OPENERS[0][0]), OPENERS[0][1])
    for prefix, kind in OPENERS[1:]:
        opener = opener.when(low.startswith(prefix), kind)
    rule = (
        F.when(t == "", "empty_text")
        .when((F.length(t) <= 120) & ~operative & T.any_in(low, ANCHORS), "cross_reference_dangling")
        .when(~parent & (F.length(t) < 100) & t.rlike(LIST_START) & ~operative, "list_marker_bare")
        .when(~parent & (F.length(t) < 80) & ~operative, "short_inert")
        .when(opener.isNotNull(), "deictic_prefix")
        .when(parent & listed, "structured_list_parent_ok")
    )
    rows = rows.withColumns({"rule": rule, "opener": opener})
    status = F.when(F.col("rule").isin("empty_text", "cross_reference_dangling", "list_marker_bare", "short_inert"), "fragmentary").when(F.col("rule") == "deictic_prefix", "context_dependent").otherwise("complete")
    named = t
    for phrase in ("This Regulation", "This Directive", "This Decision"):
        at = F.instr(F.lower(named), F.lit(phrase.lower()))
        named = F.when(at > 0, F.concat(F.substr(named, F.lit(1), at - 1), F.col("instrument"), F.substr(named, at + len(phrase)))).otherwise(named)
    article = T.blank_to_null(F.col("article_reference"))
    suggested = F.when((F.col("rule") == "deictic_prefix") & (F.col("opener") == "instrument_identity"), named).when((F.col("rule") == "deictic_prefix") & (F.col("opener") == "article_locator") & low.startswith("this article"), F.concat(article, F.substr(t, F.lit(len("this article") + 1))))
    rows = rows.withColumns({"status": status, "suggested": suggested})
    missing = F.when(F.col("rule") == "empty_text", F.array(F.lit("object"))).when(F.col("rule") == "cross_reference_dangling", F.array(F.lit("cross_reference"))).when(F.col("rule") == "list_marker_bare", F.array(F.lit("object"))).when(F.col("rule") == "short_inert", F.array(F.lit("actor"), F.lit("object"))).when(F.col("rule") == "deictic_prefix", F.array(F.col("opener"))).otherwise(F.array().cast("array<string>"))
    confidence = F.when(F.col("status") == "fragmentary", "low").when(F.col("status") == "context_dependent", F.when(F.col("suggested").isNotNull(), "medium").otherwise("low")).when(operative & (F.length(t) > 40), "high").otherwise("medium")
    return rows.select(F.concat(F.lit("pca-"), F.col("id")).alias("assessment_id"), "id", "status", "rule", confidence.alias("confidence"), missing.alias("missing_context"), "suggested")


#: The texts that explain a divergence, by its type.
RATIONALES = {
    "none": "The two propositions are materially aligned on the current comparison.",
    "procedural": "The core proposition is similar, but the conditions for compliance differ.",
    "annex_model_certificate": "The propositions differ in the documentary or record-keeping requirements.",
    "definitional": "The propositions target different legal subjects or regulated actors.",
    "textual": "The wording differs in a way that appears capable of affecting legal effect.",
    "structural": "The propositions differ in surrounding legal machinery rather than a simple like-for-like wording change.",
}


def divergence(pairs: DataFrame) -> DataFrame:
    """Type, confidence and rationale of each pair; columns of the two propositions end in _a and _b."""
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    differ = lambda c: ~a(c).eqNullSafe(b(c))
    kind = (
        F.when(F.trim(a("proposition_text")) == F.trim(b("proposition_text")), "none")
        .when(differ("authority") & ~differ("action"), "institutional")
        .when(F.array_sort(F.array_distinct(a("required_documents"))) != F.array_sort(F.array_distinct(b("required_documents"))), "annex_model_certificate")
        .when(differ("conditions"), "procedural").when(differ("legal_subject"), "definitional").when(differ("action"), "textual").otherwise("structural")
    )
    named = lambda c: F.coalesce(c, F.lit("unspecified"))
    rationale = F.when(F.col("divergence_type") == "institutional", F.concat(F.lit("The propositions preserve a similar action, but the decision-maker differs: "), named(a("authority")), F.lit(" vs "), named(b("authority")), F.lit(".")))
    for key, said in RATIONALES.items():
        rationale = rationale.when(F.col("divergence_type") == key, said)
    pairs = pairs.withColumn("divergence_type", kind)
    confidence = F.when((F.col("divergence_type") == "none") | differ("authority"), "high").otherwise("medium")
    finding = F.concat(F.lit("finding-"), a("id"), F.lit("-"), b("id"))
    return pairs.select(finding.alias("finding_id"), a("id"), b("id"), "divergence_type", confidence.alias("confidence"), rationale.alias("rationale"))


def pair_by_index(left: DataFrame, right: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The nth row of left with the nth of right for each key, the last of right where it has fewer."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    l = left.withColumn("nth", nth).select(*key, "nth", *(F.col(c).alias(f"{c}_a") for c in left.columns if c not in key))
    r = right.withColumn("nth", nth)
    last = r.groupBy(*key).agg(F.max("nth").alias("last"))
    r = r.select(*key, "nth", *(F.col(c).alias(f"{c}_b") for c in right.columns if c not in key))
    return l.join(last, key).withColumn("nth", F.least("nth", "last")).drop("last").join(r, [*key, "nth"])


REPAIR_RULES = [
    (["insufficient credit", "credit balance", "not enough credit"], "insufficient_credits"), (["quota"], "quota"), (["rate limit", "ratelimit", "429"], "rate_limit"),
    (["context window", "context_window"], "context_window"), (["model alias", "unknown model", "model not found"], "model_availability"),
    (["json parse", "jsondecode", "model call or json parse failed"], "json_parse_or_llm_failure"), (["model call failed", "llm call failure", "llm invocation", "api error", "overloaded"], "llm_call_failure"),
    (["max token", "token limit"], "other_model_infra"),
]


def repair_class(message: Column) -> Column:
    """The class of a failure that a repeated model call may mend; null for others."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.when(T.any_in(low, REPAIR_RULES[0][0]), REPAIR_RULES[0][1])
    for words, kind in REPAIR_RULES[1:]:
        out = out.when(T.any_in(low, words), kind)
    return out

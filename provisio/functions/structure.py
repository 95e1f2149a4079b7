"""The structure of a proposition's sentence: who, what rule, what, on what conditions, of what type and from when to when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import squash

# The phrases of the rules of record, in their order.
RULES = [
    r"\bdoes\s+not\s+apply\b", r"\bdo\s+not\s+apply\b", r"\bshall\s+not\b", r"\bmust\s+not\b", r"\bmay\s+not\b", r"\b(?:is|are)\s+not\s+(?:allowed|authorised|authorized|permitted)\b",
    r"\b(?:is|are)\s+(?:required|prohibited|authorised|authorized|permitted|obliged|obligated|liable)\b", r"\b(?:has|have)\s+(?:no\s+)?(?:right|power)\s+to\b", r"\b(?:has|have)\s+the\s+(?:right|power)\s+to\b",
    r"\bmust\b", r"\bshall\b", r"\bmay\b", r"\bmight\b", r"\bshould\b", r"\bwill\b", r"\bapplies\s+to\b", r"\bapplied\s+to\b", r"\bdoes\s+not\s+(?:have|receive)\b",
]
TAILS = [
    r"\s*,\s*subject\s+to\b", r"\s*,\s*without\s+prejudice\s+to\b", r"\s*,\s*where\b", r"\s*,\s*if\b", r"\s*,\s*unless\b", r"\s*,\s*provided\s+that\b",
    r"\s*,\s*in\s+so\s+far\s+as\b", r"\s*,\s*to\s+the\s+extent\s+that\b", r"\s*;\s*if\b", r"\s*;\s*unless\b", r"\s*;\s*where\b",
]
STACKED, TAIL_FROM = r"(,\s*(?:where|if|unless|provided\s+that)\b)", 18
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = rf"(?:\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}|(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s*\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})"
FROM_DATE = rf"\bfrom\s+(?:\d{{1,2}}\s+(?:{MONTHS})|(?:{MONTHS})\s+\d{{1,2}}|\d{{4}}-\d{{2}}-\d{{2}})\b"
CLAUSE_END = r"(?:\.|;|$|\s+(?:where|if|unless)\b)"
UNTIL, SOFT_UNTIL = rf"\buntil\s+([^.;]{{3,240}}?){CLAUSE_END}", r"\buntil\s+([^.;]{3,240})"
FROM = rf"\bfrom\s+({DATE}(?:[^.;]{{0,120}})?)"
BEFORE, DURING = rf"\bbefore\s+([^.;]{{3,220}}?){CLAUSE_END}", rf"\bduring\s+([^.;]{{3,220}}?){CLAUSE_END}"
TYPES = {
    "definition": [r"\bshall\s+mean\b", r"\bis\s+defined\s+as\b", r"(?:«[^»]+»|\"[^\"]{1,400}\")\s+means\b", r"\bthe\s+term\s+[^.\n]{1,120}\bmeans\b"],
    "cross_reference": [
        r"\bin\s+accordance\s+with\s+(?:Article|Articles|Annex|Chapter|Section|Part|point|paragraph)\b", r"\bin\s+accordance\s+with\s+(?:Regulation|Directive)\s*\(?", r"\bas\s+provided\s+in\b", r"\bas\s+laid\s+down\s+in\b",
        r"\bpursuant\s+to\s+(?:Article|Annex|Chapter|paragraph|points?)\b", r"\breference\s+to\s+(?:Article|Articles|Annex)\b", r"\breferred\s+to\s+in\s+(?:Article|Articles|Annex)\b",
    ],
    "exception": [r"\bby\s+way\s+of\s+derogation\b", r"\bshall\s+not\s+apply\b", r"\b(?:does|do)\s+not\s+apply\b", r"\bexcept\s+(?:where|when|if|that|for|as|in|under)\b"],
}


def _i(pattern: str) -> str:
    return f"(?i){pattern}"


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike(_i("(?:" + "|".join(patterns) + ")"))


def _clause(text: Column, pattern: str) -> Column:
    """What the pattern's group holds, squashed; null for nothing."""
    said = squash(F.regexp_extract(text, _i(pattern), 1))
    return F.when(said != "", said)


def is_temporal(clause: Column) -> Column:
    """Whether a condition speaks of a time, not of a case."""
    dated = clause.rlike(_i(DATE)) & clause.rlike(_i(r"\b(?:until|from|before)\s+"))
    return (clause != "") & (clause.rlike(_i(r"\btransitional\b")) | clause.rlike(_i(r"^(?:until|from|before|during)\b")) | dated | clause.rlike(_i(r"\bduring\s+")))


def temporal_labels(text: Column) -> Column:
    """From when to when a rule holds, as labels; null where nothing speaks of time."""
    before = _clause(text, BEFORE)
    told = [("Valid until: ", _clause(text, UNTIL)), ("Valid from: ", _clause(text, FROM)), ("Valid before: ", F.when(before.rlike(_i(DATE)) | before.rlike(_i(rf"\b(?:{MONTHS})\b")), before)), ("Applies during: ", _clause(text, DURING))]
    labels = F.array_compact(F.array(*(F.concat(F.lit(name), said) for name, said in told)))
    cue = (F.size(labels) > 0) | text.rlike(_i(r"\btransitional\b")) | text.rlike(_i(r"\buntil\s+")) | text.rlike(_i(FROM_DATE)) | (text.rlike(_i(r"\bbefore\s+")) & text.rlike(_i(DATE))) | text.rlike(_i(r"\bduring\s+"))
    soft = _clause(text, SOFT_UNTIL)
    open_ = text.rlike(_i(r"\buntil\s+")) & ~F.exists(labels, lambda x: F.startswith(x, F.lit("Valid until:"))) & soft.isNotNull()
    every = F.when(open_, F.concat(labels, F.array(F.concat(F.lit("Valid until: "), soft)))).otherwise(labels)
    return F.when(cue, every)


def with_structure(df: DataFrame, text_col: str) -> DataFrame:
    """df with subject, rule, object, conditions, core_remainder, no_modal, provision_type, temporal_labels of a text.

    The sentence ends before the first limiting clause (from character 18 on); the earliest modal phrase, the longest at one place, parts
    subject and object; without one the sentence stays whole in core_remainder. Conditions that speak of time go to the labels.
    Null and blank texts have empty fields and type core.
    """
    none = F.array().cast("array<string>")
    rows = df.withColumn("__t", F.coalesce(squash(F.col(text_col)), F.lit("")))
    t = F.col("__t")
    at = lambda text, p: F.regexp_instr(text, F.lit(_i(p))) - 1
    cuts = F.filter(F.array(*(at(t, p) for p in TAILS)), lambda x: x >= TAIL_FROM)
    rows = rows.withColumn("__cut", F.array_min(cuts)).withColumns({"__sentence": F.when(F.col("__cut").isNull(), t).otherwise(F.trim(F.substring(t, F.lit(1), F.col("__cut")))), "__tail": F.when(F.col("__cut").isNotNull(), F.substring(t, F.col("__cut") + 1, F.length(t)))})
    tail = F.trim(F.regexp_replace(F.trim(F.regexp_replace("__tail", r"^\s*,\s*", "")), r"^;\s*", ""))
    parts = F.filter(F.transform(F.split(F.regexp_replace(tail, _i(STACKED), "\u0001$1"), "\u0001"), lambda p: F.trim(p)), lambda p: (p != "") & ~is_temporal(p))
    s = F.col("__sentence")
    hits = F.filter(F.array(*(F.struct(at(s, p).alias("start"), (-F.length(F.regexp_substr(s, F.lit(_i(p))))).alias("less")) for p in RULES)), lambda h: h["start"] >= 0)
    rows = rows.withColumns({"conditions": F.coalesce(parts, none), "__hit": F.array_min(hits), "temporal_labels": temporal_labels(t)})
    hit, end = F.col("__hit.start"), F.col("__hit.start") - F.col("__hit.less")
    kind = F.when(F.col("temporal_labels").isNotNull(), "transitional")
    for name, patterns in TYPES.items():
        kind = kind.when(_any(t, patterns), name)
    found = F.col("__hit").isNotNull()
    return rows.withColumns({
        "subject": F.when(found, F.trim(F.regexp_replace(F.trim(F.substring(s, F.lit(1), hit)), "[,:;]+$", ""))).otherwise(""), "rule": F.when(found, F.substring(s, hit + 1, end - hit)).otherwise(""),
        "object": F.when(found, F.trim(F.regexp_replace(F.trim(F.substring(s, end + 1, F.length(s))), r"^[,:;-]\s*", ""))).otherwise(""), "core_remainder": F.when(found, "").otherwise(s), "no_modal": ~found,
        "provision_type": kind.otherwise("core"), "temporal_labels": F.coalesce("temporal_labels", none),
    }).drop("__t", "__cut", "__sentence", "__tail", "__hit")

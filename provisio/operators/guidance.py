"""Propositions of guidance without a model: the normative sentences of a page's sections, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def guidance_sentences(text: Column) -> Column:
    """Sentences of a section: every line by itself, cut behind . ! ? before a capital."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n"), lambda x: F.trim(x))
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+(?=[A-Z])")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def guidance_propositions(sections: DataFrame, limit: int = 5) -> DataFrame:
    """The first `limit` normative sentences of each page, as propositions.

    sections: source_url, ord, locator, text. Returns source_url, index (from 1), id, section_locator, proposition_text,
    legal_subject, action, conditions, required_documents. Pages without normative sentences give nothing; null texts are empty.
    """
    said = sections.select("source_url", "ord", F.coalesce("locator", F.lit("")).alias("section_locator"), F.posexplode(guidance_sentences(F.col("text"))).alias("pos", "proposition_text"))
    # Only a page's first rows reach its window: the limit is taken in each task before the shuffle.
    nth = F.row_number().over(W.partitionBy("source_url").orderBy("ord", "pos"))
    first = said.filter(T.guidance_normative(F.col("proposition_text"))).withColumn("index", nth).filter(F.col("index") <= limit)
    c = F.col("proposition_text")
    id_ = F.concat(F.lit("guidance-"), T.slug(F.col("section_locator")), F.lit("-"), T.short_hash(F.concat("section_locator", F.lit(":"), "index"), 8))
    return first.select("source_url", "index", id_.alias("id"), "section_locator", "proposition_text", T.guidance_subject(c).alias("legal_subject"), T.guidance_action(c).alias("action"), T.guidance_conditions(c).alias("conditions"), T.guidance_documents(c).alias("required_documents"))

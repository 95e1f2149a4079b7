"""The explorer: suppress coarse parents, group propositions, bucket, filter, sort and page the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import locators as L
from ..functions import text as T
from ..sources.runs import written

MAX_PAGE = 500


def lineage_text(text: Column) -> Column:
    """The wording under which coarse propositions are grouped: lower case, shall as must."""
    return F.regexp_replace(F.regexp_replace(F.lower(T.squash(text)), r"\bshall\b", "must"), "that the information", "that information")


def with_keys(props: DataFrame) -> DataFrame:
    """Adds lineage, coarse, cluster (the section it is shown in) and group_key (source family and lineage, else wording)."""
    # In steps, so that each expression is compiled once and reads the columns of the step before.
    place, article = F.col("fragment_locator"), F.col("article_reference")
    rows = props.withColumn("__bare", L.plain(place)).withColumn("lineage", L.lineage_key(place, F.col("__bare")))
    rows = rows.withColumns({"coarse": F.coalesce(L.is_coarse(place, F.col("__bare")), F.lit(False)), "cluster": F.coalesce(L.cluster_key(place, article, F.col("lineage"), F.col("__bare")), F.lit("none"))})
    core = F.when(F.col("lineage").isNotNull(), F.concat(F.lit("lineage:"), F.col("lineage"))).when(F.col("coarse"), F.concat_ws(":", F.lit("coarse"), "cluster", T.short_hash(lineage_text(F.col("proposition_text"))))).otherwise(F.concat(F.lit("id:"), F.col("id")))
    # Written: the rows are read more than once, and filters on a key must not be rewritten into its long expression.
    return written(rows.withColumn("group_key", F.concat(F.col("source_record_id"), F.lit("\u001f"), core)).drop("__bare"), "keyed")


def without_coarse_parents(props: DataFrame) -> DataFrame:
    """Drops rows on a whole article where the same source has a list item of that article: an anti-join."""
    article = F.regexp_extract(F.lower("lineage"), r"^article:(\d+[a-z]?):list:", 1)
    children = props.filter(F.coalesce(article, F.lit("")) != "").select(F.col("source_record_id").alias("__s"), F.concat(F.lit("article:"), article).alias("__c")).distinct()
    parents = props.filter("coarse").join(children, (F.col("source_record_id") == F.col("__s")) & (F.col("cluster") == F.col("__c")), "left_anti")
    return props.filter("NOT coarse").unionByName(parents)


def groups(props: DataFrame) -> DataFrame:
    """One row for each group: size, sources, wordings, wording status, jurisdictions, first id, cluster."""
    wording = T.squash(F.col("proposition_text"))
    g = props.groupBy("group_key", "cluster").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(wording).alias("wordings"), F.array_join(F.array_sort(F.collect_set(T.jurisdiction_label(F.col("jurisdiction")))), "|").alias("jurisdictions"), F.min("id").alias("first_id"))
    return g.withColumn("wording_status", F.when(F.col("n_rows") == 1, "single").when(F.col("wordings") == 1, "same").otherwise("different"))


def sorted_page(found: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of groups by kind of cluster, article number, suffix, then key; limit is held to 1..500, offset to 0 or more."""
    limit, offset = min(max(limit, 1), MAX_PAGE), max(offset, 0)
    number, suffix = F.regexp_extract("cluster", r":(\d+)", 1).try_cast("int"), F.regexp_extract("cluster", r":\d+([a-z]?)", 1)
    kind = F.when(F.col("cluster").startswith("article:"), 0).when(F.col("cluster").startswith("section:"), 1).when(F.col("cluster") == "none", 3).otherwise(2)
    return found.withColumns({"kind": kind, "number": number, "suffix": suffix}).orderBy("kind", F.col("number").asc_nulls_last(), "suffix", "cluster", "group_key").offset(offset).limit(limit).drop("kind", "number", "suffix")


def matches_search(needle: str, *columns: str) -> Column:
    """Whether any of the columns holds the needle, letter case aside."""
    return F.contains(F.lower(F.concat_ws("\n", *columns)), F.lit(needle.strip().lower()))

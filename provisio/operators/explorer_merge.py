"""Merging of explorer groups that say the same, their summaries, sections and the detail of one group.

Groups are compared by a signature of their rows that is summed, not gathered: each row's key is hashed, and the sums of the
hashes' parts tell multisets of rows apart. So a group of any size costs a row a task. What is many per group (its
members, the forms of its locators) comes as rows of a long table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.runs import written
from .explorer import lineage_text

# The separators of keys.
SUBGROUP, FIELD = "\u001e", "\u001d"
NO_SCOPE = ("scope:__none__", "Unscoped / other")


def _or_empty(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")), F.lit(""))


def is_primary(relevance: str = "relevance", confidence: str = "confidence") -> Column:
    """Whether a scope link is direct and of high confidence."""
    return (F.lower(_or_empty(relevance)) == "direct") & (F.lower(_or_empty(confidence)) == "high")


def subgroups(rows: DataFrame) -> DataFrame:
    """Rows (of explorer.with_keys) with sub_key: the group key, with the article cluster behind it where a group has several."""
    ends = rows.groupBy("group_key").agg(F.min("cluster").alias("__low"), F.max("cluster").alias("__high"))
    cut = F.when(F.col("__low") == F.col("__high"), F.col("group_key")).otherwise(F.concat("group_key", F.lit(SUBGROUP), "cluster"))
    return rows.join(ends, "group_key").withColumn("sub_key", cut).drop("__low", "__high")


def merge_key(scopes: Column) -> Column:
    """What makes rows mean the same: source family, jurisdiction, article, lineage, wording, status, kind and primary scopes."""
    place = _or_empty("fragment_locator")
    lineage = F.coalesce("lineage", F.concat(F.lit("__no_lineage__:"), place, F.lit(":"), _or_empty("proposition_key")))
    parts = [_or_empty("source_record_id"), F.lower(_or_empty("jurisdiction")), F.col("cluster"), lineage, lineage_text(F.col("proposition_text")), F.lower(_or_empty("effective_status")), F.lower(_or_empty("kind")), scopes]
    return F.concat_ws(FIELD, *(F.coalesce(p, F.lit("")) for p in parts))


def merged(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (of subgroups()) with merged_key: the least sub_key of all subgroups that hold the same multiset of merge keys.

    links: id, scope_id, relevance, confidence. Of rows with one id in a merged group the first by sub_key, then ord,
    stays; rows without an id all stay. Null fields are empty ones.
    """
    primary = links.filter(is_primary()).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.trim("scope_id"))), ",").alias("__scopes"))
    keyed = rows.join(primary, "id", "left")
    digest = F.sha2(merge_key(F.col("__scopes")).cast("binary"), 256)
    # Four parts of 60 bits each; sums of decimals don't overflow.
    part = lambda i: F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    signed = keyed.groupBy("sub_key").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(part(i)).alias(f"__s{i}") for i in range(4)))
    signature = ["__n", *(f"__s{i}" for i in range(4))]
    least = signed.groupBy(*signature).agg(F.min("sub_key").alias("merged_key"), F.count(F.lit(1)).alias("merged_groups"))
    names = signed.join(least, signature).select("sub_key", "merged_key", "merged_groups")
    found = rows.join(names, "sub_key")
    with_id = found.filter(_or_empty("id") != "")
    others = [c for c in found.columns if c not in ("merged_key", "id")]
    once = with_id.groupBy("merged_key", "id").agg(F.min_by(F.struct(*others), F.struct("sub_key", "ord")).alias("r")).select("merged_key", "id", "r.*")
    # Written, as summaries, sections and details read the rows several times.
    return written(once.select(found.columns).unionByName(found.filter(_or_empty("id") == "")), "merged")


def row_order() -> Column:
    """The order of a group's rows: EU, UK, others, then source, then as given."""
    label = T.jurisdiction_label(F.col("jurisdiction"))
    return F.struct(F.when(label == "EU", 0).when(label == "UK", 1).otherwise(2).alias("rank"), _or_empty("source_record_id").alias("source"), F.col("ord").alias("ord"))


def summaries(rows: DataFrame, links: DataFrame, scopes: DataFrame, completeness: DataFrame) -> DataFrame:
    """One row for each merged group.

    rows of merged(); links as there; scopes: scope_id, slug, label; completeness: id, status. Returns merged_key,
    merged_groups, n_rows, first_id, canonical_lineage, jurisdictions (EU, UK, others), wording_status, review_summary
    (status=count, by status), completeness_status (the first row's that has one), scope_slugs (in the order of the rows,
    then of their links), bucket and bucket_label (the least slug).
    """
    order = row_order()
    wording = T.squash(F.col("proposition_text"))
    ordered = rows.join(completeness.select("id", F.col("status").alias("__complete")), "id", "left").withColumn("__order", order)
    first_of = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("__order", c)))[c]
    base = ordered.groupBy("merged_key").agg(
        F.max("merged_groups").alias("merged_groups"), F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"), first_of("lineage").alias("canonical_lineage"),
        F.array_join(F.transform(F.sort_array(F.collect_set(F.when(T.jurisdiction_label(F.col("jurisdiction")) != "unknown", F.struct(F.col("__order.rank"), T.jurisdiction_label(F.col("jurisdiction")).alias("label"))))), lambda j: j["label"]), "|").alias("jurisdictions"),
        F.countDistinct(wording).alias("__wordings"), first_of("__complete").alias("completeness_status"),
    )
    said = F.when(F.col("n_rows") <= 1, "single").when(F.col("__wordings") <= 1, "same").otherwise("diff")
    status = F.when(_or_empty("effective_status") == "", "unknown").otherwise(F.lower(_or_empty("effective_status")))
    histogram = rows.groupBy("merged_key", status.alias("status")).agg(F.count(F.lit(1)).alias("n")).groupBy("merged_key").agg(F.array_join(F.sort_array(F.collect_list(F.concat("status", F.lit("="), "n"))), "|").alias("review_summary"))
    slug = F.coalesce(F.col("slug"), F.trim("scope_id"))
    linked = links.filter(is_primary()).join(scopes, "scope_id", "left").select("id", slug.alias("slug"), F.coalesce("label", slug).alias("label"), F.struct(F.col("scope_id")).alias("__link"))
    slugs = ordered.select("merged_key", "id", "__order").join(linked.filter("slug <> ''"), "id").groupBy("merged_key", "slug").agg(F.min(F.struct("__order", "__link")).alias("o"), F.min("label").alias("label"))
    # As many slugs as the taxonomy has, at most.
    slugs = slugs.groupBy("merged_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "slug"))), lambda s: s["slug"]).alias("scope_slugs"), F.min(F.struct("slug", "label")).alias("least"))
    joined = base.join(histogram, "merged_key").join(slugs, "merged_key", "left").withColumn("wording_status", said)
    return joined.select(
        "merged_key", "merged_groups", "n_rows", "first_id", "canonical_lineage", "jurisdictions", "wording_status", "review_summary", "completeness_status",
        F.coalesce("scope_slugs", F.array().cast("array<string>")).alias("scope_slugs"), F.coalesce(F.concat(F.lit("scope:"), "least.slug"), F.lit(NO_SCOPE[0])).alias("bucket"), F.coalesce("least.label", F.lit(NO_SCOPE[1])).alias("bucket_label"),
    )


def merge_members(rows: DataFrame, names: DataFrame) -> DataFrame:
    """What went into each group that was merged of several: merged_key, kind (group, artifact, locator, proposition_key), value.

    rows: subgroups(); names: merged(). A long table, as a group may have any number of each.
    """
    several = names.filter("merged_groups > 1").select("merged_key", "sub_key", "id").distinct()
    groups = several.select("merged_key", F.lit("group").alias("kind"), F.col("sub_key").alias("value"))
    artifacts = several.filter(_or_empty("id") != "").select("merged_key", F.lit("artifact").alias("kind"), F.col("id").alias("value"))
    mine = rows.join(several.select("merged_key", "sub_key").distinct(), "sub_key")
    marked = lambda mark, c: F.when(_or_empty(c) != "", F.concat(F.lit(mark), _or_empty(c)))
    forms = F.array_compact(F.array(marked("", "fragment_locator"), marked("article_ref:", "article_reference"), marked("label:", "label"), marked("article_cluster:", "cluster")))
    locators = mine.select("merged_key", F.lit("locator").alias("kind"), F.explode(forms).alias("value"))
    keys = mine.filter(_or_empty("proposition_key") != "").select("merged_key", F.lit("proposition_key").alias("kind"), _or_empty("proposition_key").alias("value"))
    return groups.unionByName(artifacts).unionByName(locators).unionByName(keys).distinct()


def sections(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Article sections in the order they first appear: cluster, first_ord, n_groups, n_rows, suppressed (coarse parents left out)."""
    shown = rows.groupBy("cluster").agg(F.min("ord").alias("first_ord"), F.countDistinct("merged_key").alias("n_groups"), F.count(F.lit(1)).alias("n_rows"))
    left_out = universe.join(rows.select("id"), "id", "left_anti").groupBy("cluster").agg(F.count(F.lit(1)).alias("suppressed"))
    return shown.join(left_out, "cluster", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(0)))


def scope_sections(summary: DataFrame) -> DataFrame:
    """Sections by scope bucket: bucket, label, n_groups, n_rows."""
    return summary.groupBy("bucket", F.col("bucket_label").alias("label")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_rows"))


def group_detail(rows: DataFrame, group: str, links: DataFrame, completeness: DataFrame, traces: DataFrame, decisions: DataFrame) -> DataFrame:
    """All that belongs to one merged group, as rows: kind (proposition, scope_link, completeness, trace, decision), id, value.

    traces: id (of the proposition), artifact_id; decisions: artifact_type, artifact_id, decision. Decisions on the
    group's propositions and on their traces both belong to it. Each relation is filtered by a semi-join.
    """
    mine = rows.filter(F.col("merged_key") == group)
    ids = mine.select("id").filter(_or_empty("id") != "").distinct()
    traced = traces.join(ids, "id", "left_semi").filter(_or_empty("artifact_id") != "").select("id", "artifact_id").distinct()
    named = ids.select(F.lit("proposition").alias("artifact_type"), F.col("id").alias("artifact_id"), "id").unionByName(traced.select(F.lit("proposition_extraction_trace").alias("artifact_type"), "artifact_id", "id"))
    decided = decisions.join(named, ["artifact_type", "artifact_id"]).select(F.lit("decision").alias("kind"), "id", F.concat_ws(":", "artifact_type", "decision").alias("value"))
    return (
        mine.select(F.lit("proposition").alias("kind"), "id", F.col("proposition_text").alias("value"))
        .unionByName(links.join(ids, "id", "left_semi").select(F.lit("scope_link").alias("kind"), "id", F.col("scope_id").alias("value")).distinct())
        .unionByName(completeness.join(ids, "id", "left_semi").select(F.lit("completeness").alias("kind"), "id", F.col("status").alias("value")))
        .unionByName(traced.select(F.lit("trace").alias("kind"), "id", F.col("artifact_id").alias("value")))
        .unionByName(decided)
    )

"""The scope taxonomy: descendants, ancestors, links of propositions to scopes, counts by scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.runs import written

#: Evidence fields of a proposition, the strongest first: (field, relevance, confidence).
FIELDS = [("proposition_text", "direct", "high"), ("legal_subject", "direct", "high"), ("required_documents", "direct", "medium"), ("conditions", "direct", "medium"), ("label", "contextual", "low")]
#: First words of the terms of a taxonomy, at most; they are a constant of the plan.
MAX_TERMS = 10_000


def closure(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """(ancestor, descendant, depth) of a tree, each node with itself at depth 0; steps number the depth of the tree.

    A pair found before is not walked again, so a cycle ends; its pairs have their least depth. Each level is written once.
    """
    edges = tree.select(F.col(node).alias("n"), F.col(parent).alias("p")).filter("p IS NOT NULL")
    level = tree.select(F.col(node).alias("ancestor"), F.col(node).alias("descendant"), F.lit(0).alias("depth")).distinct()
    found = level
    while True:
        level = level.join(edges, F.col("descendant") == F.col("p")).select("ancestor", F.col("n").alias("descendant"), (F.col("depth") + 1).alias("depth"))
        level = written(level.join(found.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti").distinct(), "level")
        if not level.take(1):
            return found
        found = found.unionByName(level)


def link_scopes(props: DataFrame, scopes: DataFrame) -> DataFrame:
    """The strongest evidence of each scope in each proposition: id, scope_id, relevance, confidence, field, term.

    scopes: scope_id, terms (lower-case words), a taxonomy of at most MAX_TERMS first words. A field holds a term if its
    words stand there in the singular or plural. Each field is split once; only those of its words that begin a term go
    on to a hash join with the terms, whose further words are then compared. Null fields and terms hold nothing.
    """
    terms = scopes.select("scope_id", F.explode("terms").alias("term"))
    forms = terms.select("scope_id", "term", F.explode(F.array("term", F.concat("term", F.lit("s")))).alias("gram")).distinct().withColumn("first", F.split("gram", " ")[0])
    firsts = sorted(r.first for r in forms.select("first").distinct().limit(MAX_TERMS + 1).collect() if r.first)
    if len(firsts) > MAX_TERMS:
        raise ValueError(f"a taxonomy has {MAX_TERMS} first words at most")
    have = [c for c in FIELDS if c[0] in props.columns]
    text = lambda c: F.array_join(c, " ") if props.schema[c].dataType.typeName() == "array" else F.col(c)
    plain = lambda c: F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))
    fields = props.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), plain(c[0]).alias("text")) for k, c in enumerate(have)))).alias("f")).select("id", "f.rank", "f.text")
    begun = fields.withColumn("first", F.explode(F.array_intersect(F.array_distinct(F.split("text", " ")), F.array(*map(F.lit, firsts)).cast("array<string>"))))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    hits = begun.join(F.broadcast(forms), "first").filter(F.contains(padded("text"), padded("gram")))
    best = hits.groupBy("id", "scope_id").agg(F.min(F.struct(F.col("rank"), (-F.length("term")).alias("l"), F.col("term"))).alias("b"))
    pick = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in have)), F.col("b.rank") + 1)
    return best.select("id", "scope_id", pick(1).alias("relevance"), pick(2).alias("confidence"), pick(0).alias("field"), F.col("b.term").alias("term"))


def inherited(links: DataFrame, tree: DataFrame, node: str, parent: str) -> DataFrame:
    """Explicit links and those to the ancestors of their scopes; an explicit one wins over an inherited one."""
    up = closure(tree, node, parent).filter("depth > 0")
    more = links.join(up, F.col("scope_id") == F.col("descendant")).select("id", F.col("ancestor").alias("scope_id"), F.lit("inherited").alias("inheritance")).distinct()
    explicit = links.select("id", "scope_id", F.lit("explicit").alias("inheritance"))
    return explicit.unionByName(more.join(explicit.select("id", "scope_id"), ["id", "scope_id"], "left_anti"))


def scope_inventory(links: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by each of the dimensions and in all: dim, key, n; by grouping sets, so the links are read once."""
    sets = ", ".join([*(f"({d})" for d in dims), "()"])
    which = " ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in dims)
    key = ", ".join(f"CAST({d} AS STRING)" for d in dims)
    query = f"SELECT CASE {which} ELSE 'all' END AS dim, coalesce({key}, 'all') AS key, count(*) AS n FROM {{links}} GROUP BY GROUPING SETS ({sets})"
    return links.sparkSession.sql(query, links=links)

"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets are apportioned twice: blocks to sources, then each source's blocks to its shards. Both use the highest
quotients target / (2k - 1), found without listing every seat: the divisor is known to lie in a narrow range, which
settles all but a few seats of each party at once. Every shard lays its documents in a seeded order on a line of
tokens, cut into blocks, and takes a seeded circular run of as many blocks as its quota says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_space_words, spool, table

BLOCK_TOKENS = 16
MAX_REPEATS = 3
SEED = "mix-1"


def _hash(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts)).cast("binary"))


def _number(hashed: Column) -> Column:
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row for each source (of source, size, copies): its documents, size, weight and target in words.

    Weights are 1, 2, 3, repeating, over the sources by code point, null last. Targets share the whole size by weight;
    none exceeds max_repeats times its source, and the excess goes to the others by weight (a water level that all
    uncapped sources share for each unit of weight).
    """
    sources = sizes.groupBy("source").agg(F.sum("copies").alias("n_docs"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    sources = sources.withColumn("place", place).withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("long"))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "place")
    everyone, before = W.partitionBy(F.lit(0)), by_cap.rowsBetween(W.unboundedPreceding, -1)
    sources = sources.withColumn("cap", F.lit(max_repeats).cast("long") * F.col("source_size"))
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    sources = sources.withColumn("level", left.cast("double") / weight).withColumn("nth", F.row_number().over(by_cap))
    sources = sources.withColumn("water", F.min_by(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")), F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("nth"))).over(everyone))
    target = F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight"))
    return sources.select("source", "place", "n_docs", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, order: str) -> DataFrame:
    """Add the column quota: seats of the group's total, by highest quotients votes / (2k - 1), ties by order.

    If rounding votes / d gives all seats, then total / d is within half the number of parties of that number. So each
    party's quota is known but for about two seats, and only those few compete by quotient.
    """
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    total, n = F.sum(votes).over(whole), F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(whole)
    bounds = parties.withColumns({"__total": total.cast("double"), "__n": n.cast("double")})
    near = lambda sign: F.col(votes) * (F.col(seats) + sign * F.col("__n") / 2) / F.col("__total")
    bounds = bounds.withColumns({
        "__sure": F.when(F.col("__total") > 0, F.greatest(F.lit(0), F.floor(near(-1) + 0.5) - 1)).otherwise(0).cast("long"),
        "__most": F.when((F.col("__total") > 0) & (F.col(votes) > 0), F.floor(near(1) + 0.5) + 2).otherwise(0).cast("long"),
    })
    bounds = bounds.withColumn("__open", F.col(seats) - F.sum("__sure").over(whole))
    seat = F.explode(F.when(F.col("__most") > F.col("__sure"), F.sequence(F.col("__sure") + 1, F.col("__most"))).otherwise(F.array().cast("array<bigint>")))
    rivals = bounds.select(*group, order, votes, "__open", seat.alias("__seat"))
    by_quotient = whole.orderBy((F.col(votes) / (2 * F.col("__seat") - 1)).desc(), order)
    won = rivals.withColumn("__rank", F.row_number().over(by_quotient)).filter("__rank <= __open").groupBy(*(F.col(k).alias(f"__{k}") for k in (*group, order))).agg(F.count(F.lit(1)).alias("__won"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*group, order)]
    return bounds.join(won, same, "left").select(*parties.columns, (F.col("__sure") + F.coalesce("__won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Returns doc_id, source, size, source_size, target, shard, taken: one row for each row of docs. A source's taken
    words differ from its target by about one block at most (where the target is max_repeats times the source, by up to a block
    a shard), no document gives more than max_repeats times its size, and the same documents always give the same result. Null or blank texts have size 0 and give nothing; the
    null source is a source. Rows that agree in id, source and size, null ids too, are laid side by side as one row with a
    count, so no id is too common; each gets its row. An empty table gives no rows.
    Shards grow as the square root of a source's documents, so neither a shard nor the list of shards is ever large.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_space_words(F.col(text_col)).alias("size"))
    sizes = spool(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    sources = source_targets(sizes, max_repeats)
    sources = sources.withColumn("blocks", F.floor(F.sum("target").over(W.partitionBy(F.lit(0))) / block_tokens + 0.5))
    sources = spool(sainte_lague(sources, [], "target", "blocks", "place").withColumn("n_shards", F.ceil(F.sqrt("n_docs")).cast("long")), "sources")
    dealt = sizes.withColumn("key", _hash(seed, F.col("doc_id")))
    dealt = dealt.join(sources, dealt["source"].eqNullSafe(sources["source"])).select("doc_id", "key", "size", "copies", "place", sources["source"], "source_size", "target", "quota", (_number(F.col("key")) % F.col("n_shards")).alias("shard"))
    dealt = dealt.withColumn("shard", F.coalesce("shard", F.lit(0)))
    shards = dealt.groupBy("place", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.first("quota").alias("blocks"))
    shards = sainte_lague(shards, ["place"], "tokens", "blocks", "shard")
    shards = spool(shards.select("place", "shard", "tokens", F.least(F.col("quota") * block_tokens, F.col("tokens") * max_repeats).alias("want")), "shards")
    first_block = _number(_hash(seed, F.col("place"), F.col("shard"))) % F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens))
    shards = shards.withColumns({"laps": F.when(F.col("tokens") > 0, F.floor(F.col("want") / F.col("tokens"))).otherwise(0).cast("long"), "start": (first_block * block_tokens).cast("long")})
    shards = shards.withColumn("stop", F.col("start") + F.col("want") - F.col("laps") * F.col("tokens"))
    line = W.partitionBy("place", "shard").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    laid = dealt.withColumn("end", F.sum(F.col("size") * F.col("copies")).over(line)).join(shards, ["place", "shard"])
    laid = laid.withColumn("behind", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("right", F.col("end") - F.col("behind") * F.col("size")).withColumn("left", F.col("right") - F.col("size"))
    shared = lambda a, b: F.greatest(F.lit(0), F.least(F.col("right"), b) - F.greatest(F.col("left"), a))
    taken = F.col("size") * F.col("laps") + shared(F.col("start"), F.col("stop")) + shared(F.lit(0), F.col("stop") - F.col("tokens"))
    return laid.select("doc_id", "source", "size", "source_size", "target", "shard", taken.cast("long").alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _quota_sql(name: str, parties: str, group: str, votes: str, order: str) -> str:
    part = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, {order}" if group else order
    return f"""
{name}_b AS (SELECT *, sum({votes}) OVER ({part}) AS total, sum(CASE WHEN {votes} > 0 THEN 1 ELSE 0 END) OVER ({part}) AS n FROM {parties}),
{name}_s AS (SELECT *, CASE WHEN {votes} > 0 THEN CAST(greatest(0, floor({votes} * (blocks - n / 2.0) / total + 0.5) - 1) AS BIGINT) ELSE 0 END AS sure,
                    CASE WHEN {votes} > 0 THEN CAST(floor({votes} * (blocks + n / 2.0) / total + 0.5) + 2 AS BIGINT) ELSE 0 END AS most FROM {name}_b),
{name}_r AS (SELECT *, unnest(generate_series(sure + 1, most)) AS seat FROM (SELECT *, blocks - sum(sure) OVER ({part}) AS rest FROM {name}_s)),
{name}_w AS (SELECT {keys}, count(*) AS won FROM (SELECT *, row_number() OVER ({part} ORDER BY CAST({votes} AS DOUBLE) / (2 * seat - 1) DESC, {order}) AS place_ FROM {name}_r) WHERE place_ <= rest GROUP BY {keys}),
{name} AS (SELECT s.*, sure + coalesce(won, 0) AS quota FROM {name}_s s LEFT JOIN {name}_w USING ({keys}))"""


OP5_SQL = rf"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src0 AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sizes GROUP BY source),
src1 AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM src0),
src2 AS (SELECT *, row_number() OVER by_cap AS nth,
                CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
         FROM src1 WINDOW by_cap AS (ORDER BY cap / weight, place), earlier AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT min_by(level, nth) AS water FROM src2 WHERE level <= cap / weight),
src3 AS (SELECT source, place, n_docs, source_size, coalesce(least(CAST(cap AS DOUBLE), water * weight), 0.0) AS target FROM src2, water),
src4 AS (SELECT *, CAST(floor(sum(target) OVER () / {BLOCK_TOKENS} + 0.5) AS BIGINT) AS blocks FROM src3),
{_quota_sql("src", "src4", "", "target", "place")},
dealt AS (SELECT doc_id, md5('{SEED}' || ':' || CAST(doc_id AS VARCHAR)) AS key, size, place, source_size, target, quota,
                 CAST('0x' || substr(md5('{SEED}' || ':' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) % CAST(ceil(sqrt(n_docs)) AS BIGINT) AS shard
          FROM sizes JOIN src ON sizes.source IS NOT DISTINCT FROM src.source),
sh0 AS (SELECT place, shard, CAST(sum(size) AS BIGINT) AS tokens, first(quota) AS blocks FROM dealt GROUP BY place, shard),
{_quota_sql("sh", "sh0", "place", "tokens", "shard")},
run0 AS (SELECT place, shard, tokens, CAST(least(quota * {BLOCK_TOKENS}, tokens * {MAX_REPEATS}) AS BIGINT) AS want,
                CAST('0x' || substr(md5('{SEED}' || ':' || place || ':' || shard), 1, 13) AS BIGINT) % CAST(greatest(1, ceil(tokens / {BLOCK_TOKENS})) AS BIGINT) * {BLOCK_TOKENS} AS start FROM sh),
run1 AS (SELECT *, CASE WHEN tokens > 0 THEN want // tokens ELSE 0 END AS laps FROM run0),
run AS (SELECT *, start + want - laps * tokens AS stop FROM run1),
laid AS (SELECT *, CAST(sum(size) OVER (PARTITION BY place, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS right_ FROM dealt)
SELECT doc_id, size, source_size, target,
       CAST(size * laps + greatest(0, least(right_, stop) - greatest(right_ - size, start)) + greatest(0, least(right_, stop - tokens) - (right_ - size)) AS BIGINT) AS taken
FROM laid JOIN run USING (place, shard)
"""

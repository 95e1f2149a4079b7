"""Sharding by balanced label propagation.

Documents with the same link value (here: equal texts) are neighbours and should share a shard, while all shards keep the
same number of rows. Documents that share their neighbours and their shard are interchangeable, so what moves are counts:
a group is a row with its number of documents in each shard. All documents are first dealt in turn, then rounds follow. In
each round every part of a group wants to join the group's largest other part. The demands from shard to shard, a small
matrix, are granted as far as the quotas allow: what wants to go the opposite way is exchanged, and documents without
neighbours, which take whatever places remain, make room. The granted moves are picked by running sums over each queue,
smallest parts first, as moving a small part away saves a cut for the fewest places, and are joined back to the groups.
No group, queue or shard is ever gathered in one task: running sums go over ranges of hashes, whose totals are summed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spool, table, whole_text

SHARDS, ROUNDS = 16, 12
#: Rows of a range of hashes, which a window keeps together: an even share of a shuffle partition, and no more than this.
RANGE_ROWS = 20_000


def running(df: DataFrame, by: list[str], rank: Column, value: str, out: str, bits: int) -> DataFrame:
    """df with `out`: the sum of `value` over the rows before, within `by`, in the order of rank (an int), then of `g`.

    g is an evenly spread long, whose first `bits` bits make the ranges. One task sums the totals of the ranges of a
    value of `by`: 2 ** bits for each rank.
    """
    cut = F.struct(rank.alias("rank"), F.shiftright("g", 64 - bits).alias("range") if bits else F.lit(0).cast("long").alias("range"))
    ranged = df.withColumns({"_by": F.struct(*by) if by else F.struct(F.lit(0).alias("all")), "_cut": cut})
    totals = ranged.groupBy("_by", "_cut").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy("_by").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_by", "_cut", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_by", "_cut").orderBy("g", "key").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.join(totals, ["_by", "_cut"]).withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.drop("_by", "_cut", "_before")


def grants(demand: list[list[int]], room: list[int]) -> list[list[int]]:
    """How much of the demand from i to j may move: as much as wants to come back, and what fits into the room of j."""
    n = len(room)
    granted = [[min(demand[i][j], demand[j][i]) if i != j else 0 for j in range(n)] for i in range(n)]
    for j in range(n):
        left = room[j]
        for i in sorted(range(n), key=lambda i: (demand[i][j] - granted[i][j], i)):
            more = min(left, demand[i][j] - granted[i][j]) if i != j else 0
            granted[i][j] += more
            left -= more
    return granted


def _loads(state: DataFrame, shards: int) -> list[int]:
    sums = state.agg(*(F.coalesce(F.sum(F.col("counts")[j]), F.lit(0)).alias(str(j)) for j in range(shards))).first()
    return list(sums)


def _wishes(state: DataFrame, open_: list[bool], turn: int) -> DataFrame:
    """key, g, source, target, count: parts of groups that want to join the largest part in an open shard."""
    shards = len(open_)
    doors = F.array(*map(F.lit, open_))
    numbered = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.struct(F.col("counts")[j].alias("count"), F.xxhash64("g", F.lit(turn), j).alias("tie"), j.alias("shard")))
    parts = F.filter(numbered, lambda p: p["count"] > 0)
    divided = state.withColumn("parts", parts).filter(F.size("parts") > 1)
    divided = divided.withColumn("best", F.array_max(F.filter("parts", lambda p: doors[p["shard"]])))
    smaller = divided.filter("best IS NOT NULL").select("key", F.xxhash64("g", F.lit(turn)).alias("g"), F.col("best.shard").alias("target"), "best", F.explode("parts").alias("part"))
    return smaller.filter("part < best").select("key", "g", F.col("part.shard").alias("source"), "target", F.col("part.count").alias("count"))


def propagate(state: DataFrame, quotas: list[int], rounds: int = ROUNDS, bits: int = 0) -> DataFrame:
    """state (key, g, counts array<long>) with its parts gathered into fewer shards; no shard's sum exceeds its quota.

    counts has the number of a group's documents in each shard, g is an evenly spread long. Rounds take turns: moves
    towards shards with free places, then exchanges with any shard. It ends when both move nothing, or after `rounds`.
    bits: see running().
    """
    shards, idle = len(quotas), 0
    for turn in range(rounds):
        room = [q - load for q, load in zip(quotas, _loads(state, shards), strict=True)]
        wishes = spool(_wishes(state, [True] * shards if turn % 2 else [r > 0 for r in room], turn), "wishes")
        demand = [[0] * shards for _ in range(shards)]
        for row in wishes.groupBy("source", "target").agg(F.sum("count").alias("n")).collect():
            demand[row.source][row.target] = row.n
        granted = grants(demand, room)
        if not any(map(any, granted)):
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        limit = F.array(*(F.array(*(F.lit(x).cast("long") for x in line)) for line in granted))
        queued = running(wishes, ["source", "target"], F.ceil(F.log2("count")).cast("int"), "count", "before", bits)
        taken = F.least(F.col("count"), limit[F.col("source")][F.col("target")] - F.col("before"))
        moves = queued.select("key", "source", "target", taken.alias("taken")).filter("taken > 0")
        # A group has one target and at most one move for each shard.
        moves = moves.groupBy("key").agg(F.first("target").alias("target"), F.collect_list(F.struct("source", "taken")).alias("moves"))
        gone = lambda j: F.aggregate(F.filter("moves", lambda m: m["source"] == j), F.lit(0).cast("long"), lambda a, m: a + m["taken"])
        come = F.aggregate("moves", F.lit(0).cast("long"), lambda a, m: a + m["taken"])
        moved = F.transform("counts", lambda c, j: c - gone(j) + F.when(j == F.col("target"), come).otherwise(0))
        state = spool(state.join(moves, "key", "left").select("key", "g", F.when(F.col("moves").isNull(), F.col("counts")).otherwise(moved).alias("counts")), "state")
    return state


def _runs(groups: DataFrame, quotas: list[int], rounds: int, bits: int) -> DataFrame:
    """key, n, runs: for each group its documents' shards as [(first, shard, slot)] by their order in the group."""
    shards = len(quotas)
    dealt = spool(running(groups, [], F.lit(0), "n", "start", bits), "dealt")
    # How many of start, …, start + n - 1 leave the rest j when divided by the number of shards.
    upto = lambda x, j: F.floor((x + (shards - 1) - j) / shards).cast("long")
    counts = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: upto(F.col("start") + F.col("n"), j) - upto(F.col("start"), j))
    state = propagate(spool(dealt.filter("n > 1").select("key", "g", counts.alias("counts")), "state"), quotas, rounds, bits)
    loads = _loads(state, shards)
    first = F.aggregate(F.slice("counts", 1, F.col("shard")), F.lit(0).cast("long"), lambda a, c: a + c)
    parts = state.select("key", "g", "counts", F.posexplode("counts").alias("shard", "count")).filter("count > 0").withColumn("first", first)
    parts = running(parts, ["shard"], F.lit(0), "count", "slot", bits)
    linked = parts.groupBy("key").agg(F.sum("count").alias("n"), F.sort_array(F.collect_list(F.struct("first", "shard", "slot"))).alias("runs"))
    # Documents without neighbours fill the free places, shard after shard.
    single = running(dealt.filter("n = 1").select("key", "g", "n"), [], F.lit(0), "n", "at", bits)
    free, begin = [], 0
    for j, (quota, load) in enumerate(zip(quotas, loads, strict=True)):
        free.append((j, begin, load))
        begin += quota - load
    place = F.array(*(F.struct(F.lit(b).cast("long").alias("begin"), F.lit(j).alias("shard"), F.lit(load).cast("long").alias("load")) for j, b, load in free))
    spot = F.array_max(F.filter(place, lambda p: p["begin"] <= F.col("at")))
    run = F.struct(F.lit(0).cast("long").alias("first"), F.col("spot.shard").alias("shard"), (F.col("spot.load") + F.col("at") - F.col("spot.begin")).alias("slot"))
    return linked.unionByName(single.withColumn("spot", spot).select("key", "n", F.array(run).alias("runs")))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", link: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, group_size, shard, slot for each row of docs.

    Shards have row counts at most one apart; slots count from 0 without gaps in each. Rows with equal `link` (any
    type that can be hashed and cast to text; the text if not given) are neighbours; a group that is larger than a shard
    fills whole shards where room allows. size is the text's UTF-8 bytes plus one. Null texts are empty texts with
    crc32 0 and neighbours of empty ones; null links are alike. Null and repeated ids, and rows that repeat
    in full, each get a place of their own; which of full repeats gets which does not matter. Fewer rows than shards
    leave shards empty, and no rows give none. Reruns agree. Other columns are not looked at.
    """
    text = whole_text(F.col(text_col)).cast("binary")
    tied = text if link is None else F.coalesce(F.concat(F.lit("="), link.cast("string")), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.substring(F.sha2(tied, 256), 1, 32)).alias("key"))
    rows = spool(rows.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "size", "text_crc32")), "rows")
    total = rows.count()
    per = max(1, min(RANGE_ROWS, total // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    quotas = [total // shards + (j < total % shards) for j in range(shards)]
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.xxhash64("key"))
    runs = spool(_runs(groups, quotas, rounds, (total // per).bit_length()), "runs")
    # Both sides are plain shuffles, so Spark can split the partition of a text with very many copies.
    met = rows.join(runs.withColumnRenamed("n", "group_size"), "key")
    part = F.pmod("h", F.floor(F.col("group_size") / per).cast("long") + 1)
    met = spool(met.withColumn("part", part), "met")
    alone = met.filter("group_size = 1").withColumn("place", F.lit(0).cast("long"))
    # Large groups are numbered part by part; the parts' counts give where each begins.
    sizes = met.filter(F.col("group_size") >= per).groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    order = Window.partitionBy("key", "part").orderBy("h", F.col("doc_id").asc_nulls_last())
    many = met.filter("group_size > 1").join(begins, ["key", "part"], "left")
    many = many.withColumn("place", F.coalesce("begin", F.lit(0)) + F.row_number().over(order) - 1)
    run = F.array_max(F.filter("runs", lambda r: r["first"] <= F.col("place")))
    placed = many.drop("begin").unionByName(alone).withColumn("run", run)
    return placed.select("doc_id", "size", "text_crc32", "group_size", F.col("run.shard").alias("shard"), (F.col("run.slot") + F.col("place") - F.col("run.first")).alias("slot"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in 16 shards of equal row counts, equal texts together."""
    found = assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_size")

"""Matching: vector top-k in blocks, best match of a statement, overlay status, duplicate scores, two-pass pairing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Components of all vectors of a block; a task holds two blocks, in single and in double precision.
BLOCK_VALUES = 2**21
#: Vectors of a block that are worth a task of their own.
LEAST_BLOCK = 1024
#: Queries and items whose products a task holds at once; pairs whose exact scores it computes at once.
TILE, PAIRS = (256, 4096), 2**16
# Order of relationships and confidences in the choice of a best match.
RELATIONSHIPS = ["confirmed", "guidance omits detail", "guidance contains additional detail", "outdated", "contradicts", "does not match"]
CONFIDENCES = ["high", "medium", "low"]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, filled up with zeros to the longest; null components are not numbers."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    rows = np.zeros((len(sizes), sizes.max(initial=0)))
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return rows


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The norm of each row, and the row over it in single precision (zeros where the norm is none)."""
    norms = np.linalg.norm(rows, axis=1)
    some = (norms > 0) & np.isfinite(norms)
    return norms, np.divide(rows, norms[:, None], out=np.zeros_like(rows), where=some[:, None]).astype(np.float32)


def _best_pairs(a: np.ndarray, b: np.ndarray, ids: np.ndarray, starts: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, ...]:
    """(row of a, item id, score): the k best items of each row, the smaller id at a tie. Row j of b has ids[starts[j]:starts[j + 1]].

    Products in single precision leave out the pairs that can't reach the threshold or the k-th best score found so far,
    by a bound of their error; all others get their score in double precision.
    """
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    (a_norms, a_unit), (b_norms, b_unit) = _unit(a), _unit(b)
    slack = 1e-6 + (width + 4) * 2.0**-23
    plain = (b_norms > 1e-150) & (b_norms < 1e150)
    found = []
    for top in range(0, len(a), TILE[0]):
        left = a_unit[top : top + TILE[0]]
        least = np.full(len(left), threshold - slack, np.float32)
        row, item, score = np.empty(0, int), np.empty(0, ids.dtype), np.empty(0)
        for at in range(0, len(b), TILE[1]):
            near = left @ b_unit[at : at + TILE[1]].T
            r, c = np.divmod(np.flatnonzero(near >= least[:, None]), near.shape[1])
            if len(r) > 64 * len(left):
                # Where nearly all pairs pass, the k-th best product of a row is a bound too.
                sure = near[:, plain[at : at + TILE[1]]]
                if sure.shape[1] >= k:
                    own_norms = a_norms[top : top + TILE[0]]
                    least = np.where((own_norms > 1e-150) & (own_norms < 1e150), np.maximum(least, np.partition(sure, -k, axis=1)[:, -k] - 2 * slack), least).astype(np.float32)
                    r, c = np.divmod(np.flatnonzero(near >= least[:, None]), near.shape[1])
            for part in range(0, len(r), PAIRS):
                q, i = top + r[part : part + PAIRS], at + c[part : part + PAIRS]
                norms = a_norms[q] * b_norms[i]
                exact = np.round(np.divide(np.einsum("ij,ij->i", a[q], b[i]), norms, out=np.zeros(len(q)), where=norms > 0), 6)
                good = exact >= threshold
                q, i, exact = q[good] - top, i[good], exact[good]
                n = starts[i + 1] - starts[i]
                own = np.repeat(starts[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
                row, item, score = np.concatenate([row, np.repeat(q, n)]), np.concatenate([item, ids[own]]), np.concatenate([score, np.repeat(exact, n)])
                order = np.lexsort((item, -score, row))
                place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                row, item, score = (x[order[place < k]] for x in (row, item, score))
                last = place[place < k] == k - 1
                least[row[last]] = np.maximum(least[row[last]], (score[last] - slack).astype(np.float32))
        found.append((top + row, item, score))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, ids.dtype), np.empty(0))


def top_k(queries: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.4, block: int | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): the k items of highest cosine at or above the threshold for each query.

    queries, items: id, vector; rows without either match nothing. Equal vectors are compared once, for all their queries
    and the k smallest ids of their items. Both sides are cut into blocks (of at most `block` vectors, or of BLOCK_VALUES
    components); every pair of blocks is one group of a cogroup, which hands on k rows a query at most. Ties go to the
    smaller item id. Products run over the common length of a pair, norms over each whole vector; a vector of zeros or
    without values scores 0.
    """
    queries, items = (df.select("id", "vector").filter("id IS NOT NULL AND vector IS NOT NULL") for df in (queries, items))
    # A query vector goes by its smallest id; ids that stand for several vectors are told apart by the mark.
    left = queries.groupBy("vector").agg(F.min("id").alias("id")).withColumn("mark", F.xxhash64("vector"))
    members = queries.withColumnRenamed("id", "query_id").join(left, "vector").select("query_id", "id", "mark")
    first = items.withColumn("place", F.row_number().over(W.partitionBy("vector").orderBy("id"))).filter(F.col("place") <= k)
    right = first.groupBy("vector").agg(F.collect_list("id").alias("ids"))

    def count(df: DataFrame) -> int:
        n, width = df.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        if block:
            return max(1, -(-n // block))
        return max(1, -(-n // max(1, BLOCK_VALUES // max(1, width or 1))), min(n // LEAST_BLOCK, queries.sparkSession.sparkContext.defaultParallelism))

    n_left, n_right = count(left), count(right) if block else max(1, -(-count(right) // 2))
    number = lambda n: F.pmod(F.xxhash64("vector", F.lit("block")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = F.col("q") * n_right + F.col("i")
    tasks = min(3 * n_left * n_right, 10_000)
    dealt = [df.select("*", cell.alias("cell")).drop("q", "i").repartition(tasks, "cell").groupBy("cell") for df in (left.withColumn("q", number(n_left)).withColumn("i", every(n_right)), right.withColumn("i", number(n_right)).withColumn("q", every(n_left)))]

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids = held["ids"].combine_chunks()
        starts = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False).astype(int))]).astype(int)
        row, item, value = _best_pairs(_matrix(asked["vector"]), _matrix(held["vector"]), ids.flatten().to_numpy(zero_copy_only=False), starts, k, threshold)
        return pa.table({"id": asked["id"].take(pa.array(row)), "mark": asked["mark"].take(pa.array(row)), "item_id": pa.array(item, pa.int64()), "score": pa.array(value, pa.float64())})

    best = dealt[0].cogroup(dealt[1]).applyInArrow(score, "id long, mark long, item_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return best.join(members, ["id", "mark"]).select("query_id", "item_id", "score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_match(matches: DataFrame) -> DataFrame:
    """The best match of each query: by relationship, then confidence, then score, then the smaller item."""
    place = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)), F.lit(99))
    order = F.struct(place("relationship", RELATIONSHIPS), place("confidence", CONFIDENCES), -F.col("score"), F.col("item_id"))
    best = matches.groupBy("query_id").agg(F.min_by(F.struct("item_id", "relationship", "confidence", "score"), order).alias("best"))
    return best.select("query_id", "best.*")


def overlay_status(matches: DataFrame) -> DataFrame:
    """none, green (all grounded matches confirm), red (all contradict) or amber for each query."""
    grounded = F.col("relationship") != "does not match"
    n = F.count_if(grounded)
    share = lambda kind: F.count_if(grounded & (F.col("relationship") == kind))
    status = F.when(n == 0, "none").when(share("confirmed") == n, "green").when(share("contradicts") == n, "red").otherwise("amber")
    return matches.groupBy("query_id").agg(status.alias("status"), n.alias("grounded"), F.count(F.lit(1)).alias("matches"))


def two_pass_pairs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Rows of two runs paired by id, then the first unmatched ones of each instrument: id_b, id_c, how.

    how: id, instrument, removed, added. Both frames: id, instrument (null or blank: none); the first is by id.
    """
    b, c = baseline.select(F.col("id").alias("id_b"), F.col("instrument").alias("inst_b")), candidate.select(F.col("id").alias("id_c"), F.col("instrument").alias("inst_c"))
    full = b.join(c, b["id_b"] == c["id_c"], "full")
    first = lambda df, i, inst: df.filter(f"{inst} <> ''").groupBy(inst).agg(F.min(i).alias(i))
    left, right = full.filter("id_c IS NULL").select("id_b", "inst_b"), full.filter("id_b IS NULL").select("id_c", "inst_c")
    second = first(left, "id_b", "inst_b").join(first(right, "id_c", "inst_c"), F.col("inst_b") == F.col("inst_c"))
    used = second.select(F.col("inst_b").alias("used"))
    removed = left.join(used, F.col("inst_b") == F.col("used"), "left_anti").select("id_b", F.lit(None).cast(c.schema["id_c"].dataType).alias("id_c"), F.lit("removed").alias("how"))
    added = right.join(used, F.col("inst_c") == F.col("used"), "left_anti").select(F.lit(None).cast(b.schema["id_b"].dataType).alias("id_b"), "id_c", F.lit("added").alias("how"))
    both = full.filter("id_b IS NOT NULL AND id_c IS NOT NULL").select("id_b", "id_c", F.lit("id").alias("how"))
    return both.unionByName(second.select("id_b", "id_c", F.lit("instrument").alias("how"))).unionByName(removed).unionByName(added)

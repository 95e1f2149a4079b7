"""Exact deduplication against a persistent digest index.

The index is a table that is bucketed and sorted by digest. Documents are reduced to narrow rows with a digest. Batch after
batch, the best row of each digest is held against the index by a sort-merge anti-join whose index side is neither
shuffled nor sorted again; what passes is appended. Which row stands for a text is then read from the index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, only, shared_dir, shared_warehouse, spool, table, unused, whole_text

#: Digests of a bucket, at most, when the index chooses their number.
BUCKET_ROWS = 1_000_000
#: Texts of so many code points or more make the first batch of the query, shorter ones the second. Any number gives
#: the same result, as the longest text of a group stays and equal lengths share a batch.
FIRST_BATCH_POINTS = 1_500


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text without white space."""
    return F.sha2(F.translate(whole_text(text), SPACES, "").cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row for each document: doc_id, n_points (code points of the text), text_sha256."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.length(whole_text(text)).cast("long").alias("n_points"), digest(text).alias("text_sha256"))


def buckets_for(rows: int) -> int:
    """How many buckets hold so many digests, BUCKET_ROWS each; at least 16."""
    return max(16, -(-rows // BUCKET_ROWS))


class DigestIndex:
    """A digest index that lives in a bucketed table and outlasts the session that made it.

    name: table to create or to go on with; buckets: files a batch adds. A new index without them takes as many as its
    first batch calls for, so give them for a corpus that will grow; one that exists keeps its own. More batches than a few
    dozen call for compact(). path: folder of the table's files, which driver and executors must share; without it they
    go to the warehouse, which must be such a folder. drop() leaves the files below a given path.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        if path is None:
            shared_warehouse(spark)
        self.spark, self.name, self.buckets, self.path = spark, name, buckets, path
        if spark.catalog.tableExists(name):
            found = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
            self.buckets = int(found["Num Buckets"])

    def rows(self) -> DataFrame | None:
        """text_sha256, keep_id, keep_points, batch of all that the index holds; None before the first batch."""
        return self.spark.table(self.name) if self.spark.catalog.tableExists(self.name) else None

    def _write(self, rows: DataFrame, name: str, mode: str) -> None:
        self.buckets = self.buckets or buckets_for(rows.count())
        writer = rows.repartition(self.buckets, "text_sha256").write.mode(mode).format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(name)

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows whose digest the index lacks."""
        index = self.rows()
        return rows if index is None else rows.join(index.select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def append(self, rows: DataFrame) -> str:
        """Hold the digests of these rows (as of digests()) against the index, append the new ones, return the batch's name.

        Of equal digests the row with the most code points, then the smallest doc_id (a null id last) goes in.
        """
        place = F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
        best = rows.groupBy("text_sha256").agg(F.min(place).alias("best"))
        batch = uuid.uuid4().hex
        new = self.missing(best).select("text_sha256", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"), F.lit(batch).alias("batch"))
        # The table that the anti-join reads is the one appended to, so the new rows are written before.
        self._write(spool(new, "new_digests"), self.name, "append")
        return batch

    def decide(self, rows: DataFrame, batches: list[str]) -> DataFrame:
        """A decision for each of these rows (as of digests()), all of whose digests the index holds.

        A row is kept if it is the one that the index names for its digest and one of these batches has put it there.
        """
        # Rows that agree in everything become one with a count, so a repeated row can't be kept twice.
        counted = spool(rows.groupBy("text_sha256", "doc_id", "n_points").agg(F.count(F.lit(1)).alias("copies")), "counted")
        sizes = counted.groupBy("text_sha256").agg(F.sum("copies").alias("group_size"))
        groups = spool(self.rows().join(sizes, "text_sha256"), "groups")
        # Both sides are plain shuffles, so Spark can split the partition of a text with very many copies.
        chosen = F.col("batch").isin(batches) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
        joined = counted.join(groups, "text_sha256")
        copies = joined.select("doc_id", "keep_id", "group_size", chosen.alias("chosen"), "text_sha256", "n_points", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        return spool(copies.select("doc_id", "keep_id", "group_size", (F.col("chosen") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_points"), "decisions")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append what is new in docs; return a decision for each of its rows.

        Returns doc_id, keep_id, group_size, kept, text_sha256, n_points. Of equal texts in one batch the row with
        the most code points, then the smallest doc_id (a null id last) stays; a text that the index already holds
        keeps its earlier row. group_size counts the rows of this batch. Null texts are empty texts, and all empty
        texts are equal. Of rows that agree in id, length and digest one is kept. An empty batch gives no rows. Ids
        may have any type that can be ordered, the same in all batches.
        """
        rows = spool(digests(docs, id_col, text_col), "digests")
        return self.decide(rows, [self.append(rows)])

    def compact(self) -> "DigestIndex":
        """Rewrite the index with one sorted file a bucket, under a new name; return that index."""
        tail = f"_{uuid.uuid4().hex[:8]}"
        target = DigestIndex(self.spark, self.name + tail, self.buckets, self.path and self.path + tail)
        target._write(self.rows(), target.name, "errorifexists")
        return target

    def drop(self) -> None:
        """Remove the index; decisions that were handed out before stay readable."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


@contextmanager
def temporary_index(spark: SparkSession, docs: DataFrame) -> Iterator[DigestIndex]:
    """An index with room for all of docs that is dropped at the end, also if the work fails.

    Its files stand beside the spooled ones: all that the work needs of the cluster is the folder of spark.checkpoint.dir.
    """
    name = f"digest_index_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, buckets_for(docs.count()), f"{shared_dir(spark)}/{name}")
    try:
        yield index
    finally:
        index.drop()


def longest_first(index: DigestIndex, docs: DataFrame, first_points: int = FIRST_BATCH_POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decisions as of DigestIndex.add() for docs in two batches: long texts, then the short ones against the index of them.

    Of equal texts the one with the most code points stays, and it is in the earliest batch that has any of them.
    """
    rows = spool(digests(docs, id_col, text_col), "digests")
    long = F.col("n_points") >= first_points
    batches = [index.append(rows.filter(long)), index.append(rows.filter(~long))]
    return index.decide(rows, batches)


def keep_distinct(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text the index or a better row of docs already holds; its columns unchanged.

    Null texts are empty texts; of rows that agree in id, length and digest one stays, also where ids are null.
    """
    id_, sha, points, own_sha, own_points = (unused(docs, f"__{c}") for c in ("id", "sha", "points", "own_sha", "own_points"))
    kept = longest_first(index, docs, id_col=id_col, text_col=text_col).filter("kept")
    kept = kept.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha), F.col("n_points").alias(points))
    text = F.col(text_col)
    keyed = docs.withColumns({own_sha: digest(text), own_points: F.length(whole_text(text)).cast("long")})
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(own_sha) == F.col(sha)) & (F.col(own_points) == F.col(points))
    # The join has left the rows dealt and sorted by this key, so dropping repeated rows needs no second shuffle.
    return only(keyed.join(kept, same, "left_semi").dropDuplicates([id_col, own_sha, own_points]), docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact deduplication of all documents by an index that takes the long texts first and the short ones after them."""
    docs = table(spark, sf_dir, "documents")
    with temporary_index(spark, docs) as index:
        found = longest_first(index, docs)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER best AS keep_id, row_number() OVER best AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w
"""

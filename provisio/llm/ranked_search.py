"""Ranked lexical search over a clustered index, with exact stopping.

Building. Documents are reduced to their terms once. Recursive graph bisection then reorders them so that documents with
common terms come to lie together: a set of documents is halved again and again, and in each halving documents change
sides as long as that lowers the logarithmic gaps of the terms' posting lists. The top of this recursion is fitted on a
bounded sample, whose halvings route every document of the corpus to its part; parts are dealt as segments of a bounded
number of documents, and each segment, in a task of its own, is bisected down to clusters of a few documents. The order only decides
what is near what; results don't depend on it. A cluster is one row of the index: its documents, its terms, how many of
its documents hold each, the greatest factor that each term has in any of them, and the postings.

Searching. A block of items is broadcast. Each task bounds all its clusters for each item by the terms' greatest factors;
the clusters with the highest bounds of all are visited first and give each item a tenth-best score to beat. Then each task
visits its clusters by falling bound and stops for an item as soon as the bound is below the item's tenth-best score, which
rises as better documents are found. A bound that equals it is still visited, as ties go to the smaller doc_id. Only the
ten best of each task are merged.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, shared_dir, spool, table, whole_text

TOP = 10
#: Documents of a cluster; documents of a segment, and bytes of its terms, roughly.
LEAF, SEGMENT, SEGMENT_BYTES = 32, 512, 16 << 20
#: The top of the bisection: hashed terms, documents of the sample (those of the smallest hashes), levels at most.
BUCKETS, SAMPLE, DEPTH = 4_096, 8_192, 8
#: Sweeps over a set of documents in each halving, at most.
SWEEPS = 8
#: (item, term) pairs of a block of items, roughly.
BLOCK_TERMS = 200_000
#: Clusters that are visited for each item before the rest.
FIRST = 2
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ASCII bytes that are neither letters nor digits part terms, A-Z are lower-cased.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def term_counts(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct terms of a UTF-8 text in order of their first occurrence, and how often each occurs."""
    counts: dict[bytes, int] = {}
    for term in text.translate(_FOLD).split():
        counts[term] = counts.get(term, 0) + 1
    return list(counts), np.fromiter(counts.values(), np.int32, len(counts))


def _buckets(terms: list[bytes]) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(t) % BUCKETS for t in terms), np.uint16, len(terms)))


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms (distinct, space-joined), tf, buckets of each document that has terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                cut = batch.slice(at, 256)
                found = [term_counts(t) for t in cut.column(1).to_pylist()]
                some = [i for i, (terms, _) in enumerate(found) if terms]
                yield pa.RecordBatch.from_arrays(
                    [
                        cut.column(0).take(pa.array(some, pa.int64())),
                        pa.array([int(found[i][1].sum()) for i in some], pa.int64()),
                        pa.array([b" ".join(found[i][0]).decode() for i in some], pa.string()),
                        pa.array([found[i][1].tobytes() for i in some], pa.binary()),
                        pa.array([_buckets(found[i][0]).tobytes() for i in some], pa.binary()),
                    ],
                    ["doc_id", "n", "terms", "tf", "buckets"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms string, tf binary, buckets binary")


@dataclass
class Lists:
    """Lists of numbers, one after the other in `flat`; list i begins at starts[i]."""

    starts: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Lists:
        return cls(np.cumsum([0, *map(len, lists)]), np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> Lists:
        size = self.starts[rows + 1] - self.starts[rows]
        starts = np.concatenate([[0], np.cumsum(size)])
        return Lists(starts, self.flat[np.arange(starts[-1]) + np.repeat(self.starts[rows] - starts[:-1], size)])

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of the values at each list's places; lists aren't empty."""
        return np.add.reduceat(values, self.starts[:-1]) if len(self) else np.zeros(0)


def halve(docs: Lists, size: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(left, weights): which documents go left, `size` of them, and for each bucket the bits it speaks for the left.

    A document's gain is the sum over its terms of what a posting costs on either side, that is the logarithmic gap in
    the term's list there, its own postings left out. The documents with the highest gains go left, until none moves.
    """
    owner = docs.owners()
    left = np.arange(len(docs)) < size
    for _ in range(sweeps):
        ours = np.bincount(docs.flat[left[owner]], minlength=BUCKETS)
        theirs = np.bincount(docs.flat, minlength=BUCKETS) - ours
        n, m = size, len(docs) - size
        weights = np.log2((ours + 1) / (n + 1)) - np.log2((theirs + 1) / (m + 1))
        stay = np.log2(np.maximum(ours, 1) / n) - np.log2((theirs + 1) / (m + 1))
        come = np.log2((ours + 1) / (n + 1)) - np.log2(np.maximum(theirs, 1) / m)
        gain = docs.sums(np.where(left[owner], stay[docs.flat], come[docs.flat]))
        now = np.zeros(len(docs), bool)
        now[np.argsort(-gain, kind="stable")[:size]] = True
        if (now == left).all():
            break
        left = now
    return left, weights


def bisect(docs: Lists, leaf: int = LEAF) -> list[np.ndarray]:
    """Recursive graph bisection: the documents' numbers in clusters of `leaf` or fewer, in their new order."""
    done, waiting = [], [np.arange(len(docs))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= leaf:
            done.append(rows)
            continue
        size = -(-len(rows) // leaf) // 2 * leaf
        left, _ = halve(docs.take(rows), size)
        waiting += [rows[~left], rows[left]]
    return done


@dataclass
class Tree:
    """The halvings of a sample: for node i of a heap, weights[i] by bucket and the gain above which a document goes left."""

    depth: int
    weights: np.ndarray
    border: np.ndarray

    @classmethod
    def fit(cls, docs: Lists, depth: int) -> Tree:
        tree = cls(depth, np.zeros((2**depth - 1, BUCKETS), np.float32), np.zeros(2**depth - 1, np.float32))
        parts = {0: np.arange(len(docs))}
        for node in range(2**depth - 1):
            rows = parts.pop(node)
            if len(rows) < 2:
                parts |= {2 * node + 1: rows, 2 * node + 2: rows[:0]}
                continue
            own = docs.take(rows)
            left, weights = halve(own, len(rows) // 2)
            tree.weights[node] = weights
            tree.border[node] = np.median(own.sums(tree.weights[node][own.flat]))
            parts |= {2 * node + 1: rows[left], 2 * node + 2: rows[~left]}
        return tree

    def route(self, docs: Lists) -> np.ndarray:
        """The part of each document: 0 to 2 ** depth - 1."""
        node, owner = np.zeros(len(docs), np.int64), docs.owners()
        for _ in range(self.depth):
            gain = docs.sums(self.weights[node[owner], docs.flat])
            node = 2 * node + np.where(gain > self.border[node], 1, 2)
        return node - (2**self.depth - 1)


def factors(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term's weight is multiplied with in a document of n terms, tf of them this one; integers throughout."""
    m = 100 - 90 + (90 * n * n_docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _lists(column: pa.Array, kind: type) -> Lists:
    return Lists.of([np.frombuffer(b, kind) for b in column.to_pylist()])


def _cluster(rows: list[dict], number: int, n_docs: int, total: int) -> dict:
    """The index row of some parsed documents."""
    places: dict[str, int] = {}
    term = np.fromiter((places.setdefault(t, len(places)) for r in rows for t in r["terms"].split(" ")), np.int64)
    tf = np.concatenate([np.frombuffer(r["tf"], np.int32) for r in rows]).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r["tf"]) // 4 for r in rows])
    n = np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(term, kind="stable")
    held = np.bincount(term, minlength=len(places))
    tops = np.maximum.reduceat(factors(tf, n[doc], n_docs, total)[order], np.cumsum(held) - held)
    return {
        "cluster": number, "doc_ids": [r["doc_id"] for r in rows], "n": n.tolist(), "terms": " ".join(places), "held": held.tolist(),
        "tops": tops.astype(np.int32).tobytes(), "post_doc": doc[order].astype(np.uint8).tobytes(), "post_tf": tf[order].astype(np.int32).tobytes(),
    }


CLUSTERS = "cluster long, doc_ids array<long>, n array<long>, terms string, held array<int>, tops binary, post_doc binary, post_tf binary"
_ARROW = pa.schema([("cluster", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("terms", pa.string()), ("held", pa.list_(pa.int32())), ("tops", pa.binary()), ("post_doc", pa.binary()), ("post_tf", pa.binary())])


@dataclass
class Index:
    """clusters: one row each; terms: term, df (documents that hold it); n_docs and total: documents with terms, their terms."""

    clusters: DataFrame
    terms: DataFrame
    n_docs: int
    total: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Index:
    """The clustered index of all documents with terms, written to a folder (of the shared one if path is not given).

    Ids are longs; null and repeated ids are documents of their own. Null and empty texts have no terms and no place.
    Documents are routed whole, whatever their length. Other columns are not looked at. No documents give an empty index.
    """
    spark = docs.sparkSession
    parsed = spool(parse(docs, id_col, text_col), "parsed")
    stats = parsed.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    depth = min(DEPTH, max(0, (stats.docs // SEGMENT).bit_length()))
    # The smallest hashes are a sample that does not depend on how the rows lie; a document has BUCKETS numbers at most.
    # Twice the share that is needed is cut off by the hash first, so that all tasks together hand over no more than that.
    share = min(1.0, 2 * SAMPLE / max(1, stats.docs))
    hashed = parsed.select("buckets", F.xxhash64("doc_id", "buckets").alias("hash")).filter(F.col("hash") <= min(2**63 - 1, int(share * 2**64) - 2**63))
    sample = hashed.orderBy("hash", "buckets").limit(SAMPLE).collect() if depth else []
    tree = Tree.fit(Lists.of([np.frombuffer(r.buckets, np.uint16) for r in sample]), depth)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, size = np.zeros(2**depth, np.int64), np.zeros(2**depth, np.int64)
        for batch in batches:
            part = tree.route(_lists(batch.column(0), np.uint16))
            many += np.bincount(part, minlength=len(many))
            np.add.at(size, part, batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(many))), pa.array(many), pa.array(size)], ["part", "docs", "bytes"])

    weighed = parsed.select("buckets", F.octet_length("terms").cast("long").alias("bytes")).mapInArrow(weigh, "part long, docs long, bytes long")
    segments = np.ones(2**depth, np.int64)
    for row in weighed.groupBy("part").agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes")).collect():
        segments[row.part] = max(1, -(-row.docs // SEGMENT), -(-row.bytes // SEGMENT_BYTES))
    first = np.cumsum(segments) - segments

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of a part are dealt over its segments in turn, from another one in each task.
        turn = np.full(len(segments), TaskContext.get().partitionId() * 7_919, np.int64)
        for batch in batches:
            part = tree.route(_lists(batch.column(4), np.uint16))
            order = np.argsort(part, kind="stable")
            many = np.bincount(part, minlength=len(segments))
            nth = np.empty(len(part), np.int64)
            nth[order] = np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many)
            segment = first[part] + (turn[part] + nth) % segments[part]
            turn += many
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], [*batch.schema.names, "segment"])

    n_docs, total = stats.docs, stats.terms

    def cluster(segment: pa.Table) -> pa.Table:
        # Rows arrive in any order; sorting them makes the clusters the same in every run.
        segment = segment.sort_by([("doc_id", "ascending"), ("terms", "ascending")])
        number, rows = segment.column("segment")[0].as_py(), segment.drop_columns(["segment", "buckets"]).to_pylist()
        parts = bisect(_lists(segment.column("buckets"), np.uint16))
        return pa.Table.from_pylist([_cluster([rows[i] for i in part], number << 32 | k, n_docs, total) for k, part in enumerate(parts)], _ARROW)

    dealt = parsed.mapInArrow(deal, "doc_id long, n long, terms string, tf binary, buckets binary, segment long")
    path = path or f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
    dealt.groupBy("segment").applyInArrow(cluster, CLUSTERS).write.parquet(f"{path}/clusters")
    clusters = spark.read.schema(CLUSTERS).parquet(f"{path}/clusters")
    each = clusters.select(F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("held").alias("held"))).alias("t"))
    each.groupBy(F.col("t.term").alias("term")).agg(F.sum("t.held").alias("df")).write.parquet(f"{path}/terms")
    return Index(clusters, spark.read.parquet(f"{path}/terms"), n_docs, total)


@dataclass
class Block:
    """A block of items: numbers of their terms one item after the other, and the weights at the same places."""

    ids: list[int | None]
    vocabulary: dict[str, int]
    terms: Lists
    weights: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str, int]]) -> Block:
        vocabulary: dict[str, int] = {}
        items: dict[int | None, list[tuple[int, int]]] = {}
        for item, term, weight in rows:
            items.setdefault(item, []).append((vocabulary.setdefault(term, len(vocabulary)), weight))
        return cls(list(items), vocabulary, Lists.of([np.array([t for t, _ in v]) for v in items.values()]), np.array([w for v in items.values() for _, w in v], np.int64))

    def known(self, terms: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of a cluster's terms that items have, and their numbers."""
        number = np.fromiter(map(self.vocabulary.get, terms.split(" "), _never), np.int64)
        place = np.nonzero(number >= 0)[0]
        return place, number[place]

    def bounds(self, place: np.ndarray, number: np.ndarray, tops: bytes) -> np.ndarray:
        """The highest score that a document of the cluster could have, for each item."""
        top = np.zeros(len(self.vocabulary), np.int64)
        top[number] = np.frombuffer(tops, np.int32)[place]
        return self.terms.sums(self.weights * top[self.terms.flat])


class _Never:
    """-1 without end, the answer for terms that no item has."""

    def __iter__(self) -> _Never:
        return self

    def __next__(self) -> int:
        return -1


_never = _Never()


@dataclass
class Visit:
    """A cluster opened for scoring: the factors of the items' terms in its documents, by row_of[term's number]."""

    doc_ids: list[int | None]
    row_of: np.ndarray
    table: np.ndarray

    @classmethod
    def of(cls, block: Block, place: np.ndarray, number: np.ndarray, row: dict, index: tuple[int, int]) -> Visit:
        held = np.array(row["held"], np.int64)
        row_of = np.full(len(block.vocabulary), len(place), np.int64)
        row_of[number] = np.arange(len(place))
        line = np.full(len(held), -1, np.int64)
        line[place] = np.arange(len(place))
        line = np.repeat(line, held)
        at = np.nonzero(line >= 0)[0]
        doc, tf = np.frombuffer(row["post_doc"], np.uint8)[at], np.frombuffer(row["post_tf"], np.int32)[at].astype(np.int64)
        factor = np.zeros((len(place) + 1, len(row["doc_ids"])), np.int64)
        factor[line[at], doc] = factors(tf, np.array(row["n"], np.int64)[doc], *index)
        return cls(row["doc_ids"], row_of, factor)

    def scores(self, block: Block, item: int) -> np.ndarray:
        at = slice(block.terms.starts[item], block.terms.starts[item + 1])
        return block.weights[at] @ self.table[self.row_of[block.terms.flat[at]]]


class Best:
    """The best documents of each item so far; least[i] is the score that a further one must reach."""

    def __init__(self, items: int, top: int, least: np.ndarray | None = None):
        self.top, self.found = top, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64) if least is None else least.copy()

    def add(self, item: int, scores: np.ndarray, doc_ids: list[int | None]) -> None:
        good = np.nonzero(scores >= self.least[item])[0]
        if not len(good):
            return
        held = self.found[item]
        held += [(-int(scores[i]), doc_ids[i] is None, doc_ids[i] or 0) for i in good]
        if len(held) >= self.top:
            held.sort()
            del held[self.top :]
            self.least[item] = max(self.least[item], -held[-1][0])

    def rows(self) -> pa.RecordBatch:
        rows = [(item, None if null else doc, -less) for item, held in enumerate(self.found) for less, null, doc in held]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])


def _merged(found: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.select("*", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= top)


def _search_block(index: Index, block: Block, top: int, first: int) -> DataFrame:
    """item (its number in the block), doc_id, score, rank."""
    facts = (index.n_docs, index.total)

    def highest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(block.ids)), np.int64)
        names: list[int] = []
        for batch in batches:
            for row in batch.to_pylist():
                held = np.vstack([held, block.bounds(*block.known(row["terms"]), row["tops"])])
                names.append(row["cluster"])
                if len(names) > 64 * first:
                    keep = np.unique(np.argsort(-held, 0, kind="stable")[:first])
                    held, names = held[keep], [names[k] for k in keep]
        for k in np.argsort(-held, 0, kind="stable")[:first]:
            bound = held[k, np.arange(len(block.ids))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(block.ids))), pa.array([names[i] for i in k], pa.int64()), pa.array(bound)], ["item", "cluster", "bound"])

    def seed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.ids), top)
        for batch in batches:
            for row in batch.to_pylist():
                place, number = block.known(row["terms"])
                visit = Visit.of(block, place, number, row, facts)
                for item in wanted.get(row["cluster"], []):
                    best.add(item, visit.scores(block, item), visit.doc_ids)
        yield best.rows()

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.ids), top, least)
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256).to_pylist()
                known = [block.known(r["terms"]) for r in rows]
                bounds = np.stack([block.bounds(*k, r["tops"]) for k, r in zip(known, rows, strict=True)])
                opened: dict[int, Visit] = {}
                for item in range(len(block.ids)):
                    for k in np.argsort(-bounds[:, item], kind="stable"):
                        if bounds[k, item] < best.least[item]:
                            break
                        if k not in opened:
                            opened[k] = Visit.of(block, *known[k], rows[k], facts)
                        best.add(item, opened[k].scores(block, item), opened[k].doc_ids)
        yield best.rows()

    by_bound = Window.partitionBy("item").orderBy(F.col("bound").desc(), "cluster")
    bounded = index.clusters.select("cluster", "terms", "tops").mapInArrow(highest, "item long, cluster long, bound long")
    starts = bounded.select("*", F.row_number().over(by_bound).alias("rank")).filter((F.col("rank") <= first) & (F.col("bound") > 0)).collect()
    wanted: dict[int, list[int]] = {}
    for row in starts:
        wanted.setdefault(row.cluster, []).append(row.item)
    found = "item long, doc_id long, score long"
    seeds = _merged(index.clusters.filter(F.col("cluster").isin(list(wanted))).mapInArrow(seed, found), top)
    least = np.ones(len(block.ids), np.int64)
    for row in seeds.filter(F.col("rank") == top).select("item", "score").collect():
        least[row.item] = row.score
    return _merged(index.clusters.mapInArrow(finish, found), top)


def search(index: Index, items: DataFrame, top: int = TOP, first: int = FIRST, block_terms: int = BLOCK_TERMS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item, those of score above 0 only.

    The score is the sum over an item's distinct terms of floor(1000 ln((2N + 2) / (2df + 1))) times the integer factor
    of factors(); equal scores go by ascending doc_id, null last. Rows that repeat an item_id are one item with the terms
    of all, and so are null ids. Items without terms, or with none that a document has, give no rows. Ids are longs.
    Items are searched in blocks of about block_terms distinct terms; one item's terms are never divided.
    """
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * index.n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.explode(F.regexp_extract_all(ascii_lower(whole_text(F.col(text_col))), F.lit(TERM), F.lit(0))).alias("term")).distinct()
    weighed = spool(asked.join(index.terms, "term").select("item_id", "term", weight.alias("weight")).filter("weight > 0"), "asked")
    blocks = -(-weighed.count() // block_terms)
    found = None
    for b in range(blocks):
        rows = weighed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "term").collect()
        block = Block.of([tuple(r) for r in rows])
        if not block.ids:
            continue
        ids = F.array(*(F.lit(i).cast("long") for i in block.ids))
        part = _search_block(index, block, top, first).select(ids[F.col("item").cast("int")].alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all `documents` for each item of `benchmark`."""
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
t AS MATERIALIZED (
  SELECT row, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT row, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM t, g GROUP BY term, n_docs),
s AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term), g GROUP BY item_id, row, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

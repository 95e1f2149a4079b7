"""SimHash near-duplicates by a self-join of binary tries over the fingerprints.

Distinct fingerprints form a binary trie. Its self-join walks pairs of nodes of one depth together, adds an error for
each level at which the two paths part, and drops a pair as soon as the errors exceed the budget. A pair within three
errors of 64 bits agrees in at least one quarter of 16 bits, so the join walks four rotations of the trie, each
with one quarter on top, and starts at the pairs of equal nodes at depth 16. Those subtries are what Spark deals out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, spool, table, unused, whole_text
from .components import components

SHINGLE = 3
BUDGET = 3
SEED = 42
#: Subtries with more fingerprints are joined slice by slice, in tasks of at most two slices each.
SLICE = 32_768
#: Node pairs a task holds at once; more are walked depth first.
FRONTIER = 400_000
#: Node pairs with so few leaf pairs are compared leaf by leaf.
LEAVES = 16
#: Shingles that are turned into bits at once.
BLOCK = 262_144


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text: majority bits over the XXH64 of its word shingles; zero for no words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    spread = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(b" ".join(s), SEED) for s in spread), "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row of docs; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), "<u8", len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def trie_links(group: np.ndarray, keys: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """A label for each key: the first of the keys that it can reach over links in its own group.

    group, keys (uint64): sorted by group, then key, without repeats; the keys of a group agree in their first
    `depth` bits. Keys of a group are linked if at most `budget` bits differ.
    """
    n = len(keys)
    label = np.arange(n)

    def link(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = label[a], label[b]
            part = x != y
            a, b, x, y = a[part], b[part], x[part], y[part]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (after := label[label]) is not None and not np.array_equal(after, label):
                label[:] = after

    sums: dict[int, np.ndarray] = {}

    def ones_before(level: int) -> np.ndarray:
        if level not in sums:
            bit = ((keys >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int64)
            sums[level] = np.concatenate(([0], np.cumsum(bit)))
        return sums[level]

    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    low, high = edge, np.append(edge[1:], n)
    stack = [(depth, np.stack([low, high, low, high, np.zeros_like(low)]))]
    while stack:
        level, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            stack += [(level, pairs[:, half:]), (level, pairs[:, :half])]
            continue
        a0, a1, b0, b1, errors = pairs
        size = (a1 - a0) * (b1 - b0)
        done = (size <= LEAVES) | (level == 64)
        if done.any():
            x0, x1, y0, y1 = a0[done], a1[done], b0[done], b1[done]
            count = (x1 - x0) * (y1 - y0)
            which = np.repeat(np.arange(len(count)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            width = (y1 - y0)[which]
            p, q = x0[which] + nth // width, y0[which] + nth % width
            near = (p < q) & (np.bitwise_count(keys[p] ^ keys[q]) <= budget)
            link(p[near], q[near])
            a0, a1, b0, b1, errors = (c[~done] for c in (a0, a1, b0, b1, errors))
        if not len(a0):
            continue
        ones = ones_before(level)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)  # a node with itself: of its children's two mixed pairs one is enough
        mixed = ~same
        children = np.concatenate([
            np.stack([a0, am, b0, bm, errors]), np.stack([am, a1, bm, b1, errors]), np.stack([a0, am, bm, b1, errors + 1]),
            np.stack([am, a1, b0, bm, errors + 1])[:, mixed],
        ], axis=1)
        alive = (children[4] <= budget) & (children[1] > children[0]) & (children[3] > children[2])
        alive &= ~((children[0] == children[2]) & (children[1] - children[0] == 1))
        if alive.any():
            stack.append((level + 1, children[:, alive]))
    return label


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp) that span their groups of links at most `budget` bits long.

    Of the links inside one subtrie only a spanning forest is returned, so edges number four a fingerprint at most.
    """
    parts = budget + 1
    depth = 64 // parts
    fp = F.col("fp")
    turned = lambda r: fp if not r else F.shiftleft(fp, r * depth).bitwiseOR(F.shiftrightunsigned(fp, 64 - r * depth))
    keys = distinct.select(F.explode(F.array(*(F.struct(F.lit(r).alias("turn"), turned(r).alias("key")) for r in range(parts)))).alias("k")).select("k.*")
    keys = keys.withColumn("bucket", (F.shiftrightunsigned("key", 64 - depth) * parts + F.col("turn")).cast("long"))
    # Buckets number (budget + 1) * 2^depth at most, 262,144 by default, so the list of large ones is bounded.
    large = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SLICE).select("bucket", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    keys = keys.join(F.broadcast(large), "bucket", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")
    keys = keys.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    keys = keys.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "turn", "key")
    dealt = keys.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", F.col("key").bitwiseXOR(F.lit(-(2**63))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(rows: pa.Table) -> pa.RecordBatch:
            bucket, i, j, turn, key = (rows.column(c).to_numpy() for c in ("bucket", "i", "j", "turn", "key"))
            new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            label = trie_links(np.cumsum(new), key.view(np.uint64), depth, budget)
            hung = np.flatnonzero(label != np.arange(len(label)))
            back = (turn[hung] * depth).astype(np.uint64)
            a, b = key.view(np.uint64)[hung], key.view(np.uint64)[label[hung]]
            unturn = lambda x: np.where(back > 0, (x >> back) | (x << (np.uint64(64) - np.maximum(back, np.uint64(1)))), x).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(unturn(a)), pa.array(unturn(b))], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * SLICE:
                rows = pa.Table.from_batches(held)
                last = tuple(rows.column(c)[-1].as_py() for c in ("bucket", "i", "j"))
                other = np.flatnonzero((rows.column("bucket").to_numpy() != last[0]) | (rows.column("i").to_numpy() != last[1]) | (rows.column("j").to_numpy() != last[2]))
                whole = int(other[-1]) + 1 if len(other) else 0
                if whole:
                    yield joined(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield joined(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for each row of docs.

    Texts whose fingerprints differ in at most `budget` bits are linked, and component_id is the smallest id reachable
    over links. Null, empty and blank texts have fingerprint zero and are linked like any other. Rows that repeat each
    get their row. A null id has its fingerprint and component too; the component id is null if no row of it has an id.
    """
    prints = spool(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = spool(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(distinct, budget))
    rooted = spool(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = spool(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = spool(rooted.join(lowest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component; its columns unchanged.

    That of the smallest id stays, a null id last, then that of the smallest hash of the text; of rows that agree in
    both, any one.
    """
    # A row's key tells rows of one id apart, and null ids in it are equal; the component's id is the key that stays.
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    own, gone = unused(docs, "__key"), unused(docs, "__dropped")
    keyed = docs.withColumn(own, key)
    found = near_duplicates(keyed, shingle, budget, own, text_col)
    dropped = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone)).distinct()
    kept = keyed.join(dropped, F.col(own) == F.col(gone), "left_anti").dropDuplicates([own])
    return only(kept, docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

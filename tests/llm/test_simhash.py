"""SimHash near-duplicates against brute force."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from provisio.llm import simhash
from provisio.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashed = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashed) > len(hashed))


def brute_components(prints, ids):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = min((v for v in (least.get(r), x) if v is not None), default=None)
    return [least[find(i)] for i in range(len(prints))]


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    prints = [brute_print(t) for _, t in docs]
    want = {d: (f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, brute_components(prints, [d for d, _ in docs]), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, sf_dir).collect()}
    assert got == want


def test_trie_links_brute_force():
    rng = random.Random(5)
    keys = set()
    for _ in range(40):
        seed = rng.getrandbits(48)
        for _ in range(rng.randrange(1, 40)):
            x = seed
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(48)
            keys.add(x)
    keys = sorted(keys)
    label = simhash.trie_links(np.zeros(len(keys), np.int64), np.array(keys, np.uint64), 16, 3)
    assert label.tolist() == brute_components(keys, list(range(len(keys))))


def test_large_buckets_in_slices(spark, monkeypatch):
    """A subtrie above the slice size gives the same components."""
    monkeypatch.setattr(simhash, "SLICE", 16)
    rng = random.Random(8)
    fps = sorted({(7 << 48 | rng.getrandbits(6) << 20 | rng.getrandbits(5)) for _ in range(150)})
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    root = {r.node: r.root for r in components(edges).collect()}
    assert [root.get(x, x) for x in fps] == brute_components(fps, fps)


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 1), (3, " \t\n", 2), (4, "One", 3), (4, "One", 3), (5, "oNE", 4), (None, "one", 5), (6, "a b c d " * 30_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    by_id = {d: c for d, _, c in got}
    assert by_id[1] == by_id[2] == by_id[3] == 1
    assert by_id[4] == by_id[5] == by_id[None] == 4
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("component_id", docs["fp"]))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_keep_one_decides_by_row(spark):
    """Null ids and repeated ids: unique texts stay, and one row of each component stays."""
    text = lambda n: " ".join(f"w{n}x{k}" for k in range(40))
    rows = [(1, text(1)), (None, text(1)), (None, text(2)), (None, text(3)), (None, text(3)), (2, text(4)), (3, text(4)), (3, text(5)), (3, text(6)), (4, text(7)), (4, text(7)), (4, text(8)), (None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, text(1)), (None, text(2)), (None, text(3)), (2, text(4)), (3, text(5)), (3, text(6)), (4, text(7)), (4, text(8)), (None, None)]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, 8), (2, "a b c d", 7, 8), (3, "other words are here", 7, 8)], "doc_id long, text string, __key int, __dropped int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components_of_a_hub(spark):
    """A star of many leaves, its hub neither the smallest nor the largest node."""
    edges = spark.createDataFrame([(500, i) for i in range(1000) if i != 500], "a long, b long")
    assert {r.root for r in components(edges).collect()} == {0}

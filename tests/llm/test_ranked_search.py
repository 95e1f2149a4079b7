"""Ranked search against brute force, over any order of the documents; the parts of bisection and index by themselves."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from provisio.llm import ranked_search as R

DOCS = "doc_id long, text string, n int, cluster string, terms int"
ITEMS = "item_id long, text string, term string, weight int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, top=10):
    parsed = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n_docs, total = len(parsed), sum(sum(c.values()) for _, c in parsed)
    df = Counter(t for _, c in parsed for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for d, c in parsed:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def _search(spark, docs, items, **kw):
    index = R.build(spark.createDataFrame([(*d, 1, "c", 2) for d in docs], DOCS).repartition(3))
    found = R.search(index, spark.createDataFrame([(*i, "t", 0) for i in items], ITEMS), **kw)
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str), index


def _corpus(seed, n=400):
    rng = random.Random(seed)
    topics = [[f"w{k}x{i}" for i in range(40)] for k in range(6)]
    text = lambda: " ".join(rng.choices(topics[rng.randrange(6)], k=rng.randint(1, 30)) + rng.choices(["The", "of,", "É2", "straße"], k=rng.randint(0, 9)))
    docs = [(i, text()) for i in range(n)]
    docs += [(5, docs[5][1])] * 40 + [(i, "same words here the") for i in range(900, 880, -1)]  # ties by the dozen
    docs += [(None, "same words here the"), (None, "w1x1 w1x2"), (990, None), (991, ""), (992, "?! _"), (993, "w0x1 " * 50_000 + "rare")]
    items = [(i, text()) for i in range(12)] + [(50, "SAME words, here"), (51, None), (52, "unheard"), (None, "w1x1"), (None, "w1X2 rare"), (53, "w2x1"), (53, "w3x1 w2x1")]
    return docs, items


@pytest.mark.parametrize("segment", [512, 24])
def test_equals_brute_force(spark, monkeypatch, segment):
    """One segment of several clusters; many segments below a tree of several levels."""
    monkeypatch.setattr(R, "SEGMENT", segment)
    docs, items = _corpus(segment)
    found, index = _search(spark, docs, items)
    assert found == brute(docs, items)
    sizes = index.clusters.select(F.size("doc_ids").alias("n")).collect()
    assert sum(r.n for r in sizes) == index.n_docs == len([1 for _, t in docs if words(t)]) and max(r.n for r in sizes) <= R.LEAF


def test_blocks_of_items_and_short_lists(spark):
    docs, items = _corpus(1, 60)
    assert _search(spark, docs, items, top=3, block_terms=20)[0] == brute(docs, items, 3)


def test_no_rows(spark):
    assert _search(spark, [], [(1, "a")])[0] == []
    assert _search(spark, [(1, "a b")], [])[0] == []
    assert _search(spark, [(1, None)], [(1, "a")])[0] == []


def test_bisection_brings_like_documents_together():
    """Documents of eight topics in mixed order: clusters hold few topics each, and every document is in one cluster."""
    rng = np.random.default_rng(0)
    topic = rng.integers(0, 8, 512)
    docs = R.Lists.of([np.unique(rng.integers(0, 60, 25) + 60 * t) for t in topic])
    parts = R.bisect(docs, 32)
    assert sorted(np.concatenate(parts).tolist()) == list(range(512)) and max(map(len, parts)) == 32
    assert np.mean([np.bincount(topic[p]).max() / len(p) for p in parts]) > 0.85
    routed = R.Tree.fit(docs, 3).route(docs)
    assert np.bincount(routed, minlength=8).max() < 2 * 64
    assert np.mean([np.bincount(topic[routed == p]).max() / (routed == p).sum() for p in range(8) if (routed == p).any()]) > 0.6


def test_bounds_hold_and_let_clusters_be_passed_over(spark):
    docs, items = _corpus(7)
    found, index = _search(spark, docs, items)
    df = {r.term: r.df for r in index.terms.collect()}
    asked = {(i, t) for i, text in items if i is not None for t in words(text) if t in df}
    block = R.Block.of([(i, t, math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df[t] + 1)))) for i, t in sorted(asked)])
    tenth = {i: s for i, k, _, s in found if k == 10}
    least = np.array([tenth.get(i, 1) for i in block.ids])
    visited = []
    for row in index.clusters.collect():
        place, number = block.known(row.terms)
        bounds = block.bounds(place, number, row.tops)
        visit = R.Visit.of(block, place, number, row.asDict(), (index.n_docs, index.total))
        assert all(visit.scores(block, i).max() <= bounds[i] for i in range(len(block.ids)))
        visited.append(bounds >= least)
    assert np.mean(visited) < 0.7


def test_query_over_the_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, R.op13_ranked_search(spark, sf_dir).collect()), key=str) == brute(docs, items)

"""Mixing: apportionment against the list of all seats, targets and limits on the whole table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from provisio.llm import mixing as X


def test_sainte_lague_is_the_highest_quotients(spark):
    rng = random.Random(3)
    rows = [(g, i, float(rng.choice([0, 1, 7, 50, 333, 1000])), 40 + 13 * g) for g in range(4) for i in range(9)]
    rows = [r for r in rows if r[0] != 3] + [(3, i, 5.0, 7) for i in range(9)]
    got = {(r.g, r.i): r.quota for r in X.sainte_lague(spark.createDataFrame(rows, "g int, i int, votes double, seats long"), ["g"], "votes", "seats", "i").collect()}
    for g in range(4):
        own = [r for r in rows if r[0] == g]
        seats = sorted((-v / (2 * k - 1), i) for _, i, v, s in own if v for k in range(1, s + 1))[: own[0][3]]
        assert {i: got[g, i] for _, i, _, _ in own} == {i: sum(j == i for _, j in seats) for _, i, _, _ in own}


def _targets(sizes):
    left, weights, out = sum(sizes.values()), {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}, {}
    free = set(sizes)
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return out


def _check(rows, slack):
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    goals = _targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goals[r.source]) and 0 <= r.taken <= 3 * r.size
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= slack + 0.01 * goals[s], s


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, again = (X.mix(docs.repartition(n)).collect() for n in (2, 5))
    assert sorted(map(str, first)) == sorted(map(str, again))
    _check(first, X.BLOCK_TOKENS)
    assert X.op5_mixing(spark, sf_dir).count() == docs.count()


def test_edge_cases(spark):
    rows = [(1, None, "a", 1.0), (2, "", "a", 1.0), (3, "w " * 50_000, None, 2.0), (None, "x y z " * 40, "b", 1.0), (4, "p q " * 30, "b", 1.0), (4, "p q " * 30, "b", 1.0), (5, "only " * 64, "c", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = X.mix(docs).collect()
    assert len(got) == len(rows)
    _check(got, X.BLOCK_TOKENS)
    assert X.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in X.mix(docs.filter(F.col("doc_id") < 3)).collect()} == {0}


def test_common_ids_are_one_row_with_a_count(spark):
    """Null ids and rows of one id share a line of tokens; each row takes at most its repeats, and the target is met."""
    rows = [(None, "x y z " * 5, "a")] * 300 + [(7, "p q " * 4, "a")] * 300 + [(i, "r s t " * 6, "b") for i in range(20)]
    got = X.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    _check(got, 16 * X.BLOCK_TOKENS)

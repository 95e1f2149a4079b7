"""Vector codes against brute force over plain integers; the VA-file's bounds against real distances."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from provisio.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(best(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    coded = []
    for i, v, lab in kept:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        coded.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return coded, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def _hold(spark, rows, parts=2, entries=4, rounds=2):
    codes, books = V.compress(spark.createDataFrame([(*r, "c", "e") for r in rows], SCHEMA), parts, entries, rounds)
    coded, sha = brute(rows, parts, entries, rounds)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, codes.select("id", "label", "code", "error").collect()), key=key) == sorted(coded, key=key)
    assert V.fingerprint(books) == sha


def test_edge_cases(spark):
    """Nulls, NaN and infinity in any place, repeated rows and ids, ties, null ids and labels, clashing columns."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 4) / 8], int(i) % 3) for i in range(60)]
    rows += [(3, None, 1), (4, [0.0, None, 0.0, 1.0], 1), (5, [float("nan")] * 4, 2), (6, [0.0, float("-inf"), 0.0, 0.0], 2)]
    rows += [rows[0], rows[0], (0, [0.5, -0.5, 0.25, 1.0], None), (None, [1.0, 2.0, -3.0, 0.001], None), (None, [1.0, 2.0, -3.0, 0.001], 0)]
    _hold(spark, rows)
    _hold(spark, rows[:3])
    _hold(spark, [(1, [0.25] * 4, 0)] * 20)


def test_no_rows_and_wrong_shapes(spark):
    none = spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)
    codes, books = V.compress(none)
    assert codes.count() == 0 and sum(b.size for b in books) == 0
    for vectors in ([[0.0, 1.0, 2.0]], [[0.0] * 16, [0.0] * 32], [[3e9] * 16]):
        with pytest.raises(ValueError):
            V.compress(spark.createDataFrame([(1, v, 1, "", "") for v in vectors], SCHEMA))


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold_and_leave_few_candidates(seed):
    rng = np.random.default_rng(seed)
    entries, queries = rng.normal(0, 60, (64, 4)).astype(np.int64), rng.normal(0, 60, (500, 4)).astype(np.int64)
    file = V.va_file(entries)
    below, above = V.bounds(file, queries)
    exact = ((queries[:, None] - entries[None]) ** 2).sum(2)
    assert (below <= exact).all() and (exact <= above).all()
    found, distance = V.nearest(file, queries)
    assert (found == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert (below <= above.min(1, keepdims=True)).mean() < 0.25


def test_query_over_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    coded, sha = brute(rows, 16, 64, 2)
    sums = {}
    for _, lab, _, error in coded:
        sums[lab] = sums.get(lab, 0) + error
    want = sorted((i, code, error, sums[lab], sha) for i, lab, code, error in coded)
    assert sorted(map(tuple, V.op12_vector_codes(spark, sf_dir).collect())) == want

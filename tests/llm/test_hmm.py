"""The hidden Markov language model against plain recursions and counts."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from provisio.llm import hmm
from provisio.llm.common import in_fold


def _model(states=3, symbols=7):
    rng = np.random.default_rng(2)
    dealt = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape) + 0.1)
    return hmm.Model(dealt(states), dealt(states, states), dealt(states, symbols))


def _likelihood(m, seq):
    """Sum over all paths."""
    a = m.start * m.emit[:, seq[0]]
    for s in seq[1:]:
        a = (a @ m.move) * m.emit[:, s]
    return a.sum()


SEQS = [np.array(s, np.uint16) for s in ([0], [1, 2, 3], [6, 6, 6, 0, 1], [2, 5], [3, 1, 4, 1, 5, 2])]


def test_forward_is_exact():
    m = _model()
    assert hmm.forward(m, SEQS) == pytest.approx([math.log10(_likelihood(m, s)) for s in SEQS], rel=1e-12)


def test_expected_counts_and_likelihood_rises():
    m = _model()
    got = hmm.expected(m, SEQS)
    assert got.start.sum() == pytest.approx(len(SEQS), rel=1e-5)
    assert got.move.sum() == pytest.approx(sum(len(s) - 1 for s in SEQS), rel=1e-5)
    assert got.emit.sum(0) == pytest.approx(np.bincount(np.concatenate(SEQS), minlength=7), rel=1e-5)
    better = hmm.Model(got.start / got.start.sum(), got.move / got.move.sum(1, keepdims=True), got.emit / got.emit.sum(1, keepdims=True))
    assert hmm.forward(better, SEQS).sum() > hmm.forward(m, SEQS).sum()


def _expected(m, seq):
    """Counts from the plain forward and backward tables of one sequence."""
    a, b = [m.start * m.emit[:, seq[0]]], [np.ones(len(m.start))]
    for x in seq[1:]:
        a.append((a[-1] @ m.move) * m.emit[:, x])
        a[-1] /= a[-1].sum()
    for x in seq[:0:-1]:
        b.append(m.move @ (m.emit[:, x] * b[-1]))
        b[-1] /= b[-1].sum()
    b.reverse()
    state = [u * v / (u @ v) for u, v in zip(a, b, strict=True)]
    moves, emitted = np.zeros_like(m.move), np.zeros_like(m.emit)
    for t in range(1, len(seq)):
        x = a[t - 1][:, None] * m.move * (m.emit[:, seq[t]] * b[t])[None, :]
        moves += x / x.sum()
    for t, x in enumerate(seq):
        emitted[:, x] += state[t]
    return state[0], moves, emitted


@pytest.mark.parametrize("block", [2, 3, 2048])
def test_expected_counts_are_those_of_whole_texts(monkeypatch, block):
    """Blocks of any length give the counts of the uncut recursion."""
    monkeypatch.setattr(hmm, "BLOCK", block)
    m, rng = _model(), np.random.default_rng(4)
    seqs = [*SEQS, *(rng.integers(0, 7, n).astype(np.uint16) for n in (4, 7, 8, 9, 40))]
    got, want = hmm.expected(m, seqs), [_expected(m, s) for s in seqs]
    assert got.start == pytest.approx(sum(w[0] for w in want), rel=1e-9)
    assert got.move == pytest.approx(sum(w[1] for w in want), rel=1e-9)
    assert got.emit == pytest.approx(sum(w[2] for w in want), rel=1e-9)


def test_scores_by_brute_force(spark, sf_dir):
    """The score column of the whole query: plain Baum-Welch steps and forward tables over whole texts."""
    docs = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()}
    train = [ws for d, ws in docs.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    counts = Counter(w for ws in train for w in ws)
    of = lambda w: zlib.crc32(w[-5:]) % 4096 if w else 4096
    size, kinds = np.zeros(4097), np.zeros(4097)
    for w, c in counts.items():
        size[of(w)] += c
        kinds[of(w)] += 1
    share = size + 0.5 * (kinds + 1)
    m = hmm.first_model(share / share.sum())
    mass = m.emit.mean(0)
    for _ in range(hmm.STEPS):
        found = [_expected(m, [of(w) for w in ws]) for ws in train]
        start, move, emit = (sum(f[i] for f in found) + (0.5 if i < 2 else 0.5 * 4097 * mass) for i in range(3))
        m = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("doc_id").isin(list(docs)))
    got = {r.doc_id: r.score for r in hmm.score(rows, in_fold(F.col("doc_id"), 1)).collect()}
    for d, ws in docs.items():
        a, total = m.start, 0.0
        for t, w in enumerate(ws):
            a = (a if not t else a @ m.move) * m.emit[:, of(w)]
            total += math.log10(a.sum())
            a = a / a.sum()
        words = sum(math.log10((counts[w] + 0.5) / share[of(w)]) for w in ws)
        assert got[d] == pytest.approx(total + words, rel=1e-5)


def test_whole_table(spark, sf_dir, monkeypatch):
    """Base scores and counts by brute force, with few words looked up map-side; the model beats the base on held-out texts."""
    monkeypatch.setattr(hmm, "FREQUENT", 50)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    tokens = {d: (t or "").encode().lower().split() + [b""] for d, t in docs}
    counts = Counter(w for d, ws in tokens.items() if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in hmm.op2_hmm(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "A b " * 40_000, "x"), (3, "A b " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = hmm.score(docs, in_fold(F.col("doc_id"), 1), steps=1).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 80_001, 80_001]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert hmm.score(docs.limit(0), F.lit(False), steps=1).count() == 0
    untrained = hmm.score(docs, F.lit(True), steps=1).collect()
    assert {r.n_known for r in untrained} == {0} and {r.base_score for r in untrained} == {0.0}

"""The quality network: gradients, pooling over whole texts, held-out accuracy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from provisio.llm import quality as X
from provisio.llm.common import in_fold


def _net():
    net = X.Network.new(3)
    net.tabulate()
    return net


def _slow(net, text):
    data = (text or b"\0") + bytes(X.WIDTH - 1)
    found = np.array([sum(net.filters[w][data[i + w]] for w in range(X.WIDTH)) for i in range(len(data) - X.WIDTH + 1)])
    seen = np.array([np.maximum(found[i : i + X.CHUNK].max(0) + net.bias, 0) for i in range(0, len(found), X.CHUNK)])
    return seen.max(0), seen.mean(0)


def test_pooling_reads_every_byte(monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 16)
    monkeypatch.setattr(X, "BLOCK", 64)
    rng, net = np.random.default_rng(1), _net()
    texts = [bytes(rng.integers(0, 256, n, np.uint8)) for n in (0, 1, 5, 16, 17, 64, 65, 200, 1000, 3)]
    top, mean = X.pooled(net, iter(texts))
    for i, t in enumerate(texts):
        a, b = _slow(net, t)
        assert top[i] == pytest.approx(a, abs=1e-5) and mean[i] == pytest.approx(b, abs=1e-5)


def test_gradient(monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 8)
    net, texts, goal = _net(), [b"hello world, good day", b"x" * 30, b""], np.array([1.0, 0.0, 1.0])

    def loss():
        net.tabulate()
        p = net.probability(*X.pooled(net, iter(texts)))
        return -(goal * np.log(p) + (1 - goal) * np.log(1 - p)).mean()

    grads = X._gradient(net, texts, goal)
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in list(zip(*np.nonzero(np.abs(g) > 1e-3), strict=True))[:4]:
            keep, p[at] = p[at], p[at] + 1e-3
            up = loss()
            p[at] = keep - 1e-3
            down = loss()
            p[at] = keep
            assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.05, abs=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = X.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


def test_scores_by_brute_force(spark, sf_dir):
    """Every score of the query: the same network over all windows of all bytes, one at a time."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = X.fit(docs, labels, ~in_fold(F.col("doc_id"), 0))
    got = {r.doc_id: r for r in X.op7_quality(spark, sf_dir).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert got.keys() == texts.keys()
    for d in sorted(texts, key=lambda d: len(texts[d]))[::5]:
        top, mean = _slow(net, texts[d])
        want = 1 / (1 + np.exp(-(np.concatenate([top, mean]) @ net.weights + net.level[0])))
        assert got[d].score == pytest.approx(want, abs=1e-4) and got[d].predicted == int(got[d].score >= 0.3)


def test_long_texts_teach(spark, monkeypatch):
    """The sample is bounded by rows and by bytes in all, not by the length of a text."""
    taught = []
    monkeypatch.setattr(X, "train", lambda texts, goal: taught.append((texts, goal)) or X.Network.new())
    docs = spark.createDataFrame([(i, ("x" if i % 2 else "yz") * (40_000 * i)) for i in range(1, 6)] + [(2, "yz" * 80_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, quality int")
    X.fit(docs, labels, F.lit(True))
    assert sorted(map(len, taught[0][0])) == [40_000, 120_000, 160_000, 200_000, 320_000] and taught[0][1].sum() == 3
    monkeypatch.setattr(X, "SAMPLE_BYTES", 350_000)
    X.fit(docs, labels, F.lit(True))
    assert 0 < sum(map(len, taught[1][0])) <= 350_000


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "text", 3), (3, "é" * 200_000, 4), (3, "é" * 200_000, 4)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (7, 0)], "doc_id long, quality int")
    got = X.score(docs, labels, F.lit(True)).collect()
    assert len(got) == 5 and all(0 <= r["__quality"] <= 1 for r in got) and got[0].quality
    assert {r["__quality"] for r in X.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert X.score(docs.limit(0), labels, F.lit(True)).count() == 0

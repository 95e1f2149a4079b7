"""Quality classifier: a byte-level convolutional network in numpy over all chunks of a document.

Filters of WIDTH bytes slide over the whole document. Each chunk of windows (neighbouring chunks overlap by WIDTH - 1
bytes, so no window is lost) gives the largest response of every filter; the largest and the mean over all chunks go
through one logistic unit. Two neighbouring bytes index a table that already holds the sum of their weights, so a
window costs three lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold, table, whole_text

WIDTH, FILTERS = 6, 8
#: Windows in a chunk, and windows that are computed at once.
CHUNK, BLOCK = 1024, 131_072
#: Labelled rows that the network is fitted on, at most (the smallest by a hash of their id), and the bytes of their whole
#: texts together: rows are taken in that order, and one that does not fit into what is left of the bytes is passed over.
SAMPLE, SAMPLE_BYTES = 2_048, 33_554_432
EPOCHS, BATCH, RATE, SEED = 12, 32, 0.02, 11


@dataclass
class Network:
    """filters [WIDTH, 256, FILTERS], bias [FILTERS], weights [2 * FILTERS] (largest, mean), level [1]."""

    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    level: np.ndarray
    pairs: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def new(cls, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, 2 * FILTERS), np.zeros(1))

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.weights, self.level]

    def tabulate(self) -> None:
        """Sums of the weights of two neighbouring bytes, [65536, FILTERS] for each pair of places."""
        self.pairs = [(self.filters[w][:, None, :] + self.filters[w + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32) for w in range(0, WIDTH, 2)]

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Of all windows of the bytes, [len(data) - WIDTH + 1, FILTERS]."""
        two = (data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]
        n = len(data) - WIDTH + 1
        out = self.pairs[0][two[:n]]
        for w in range(2, WIDTH, 2):
            out += self.pairs[w // 2][two[w : w + n]]
        return out

    def probability(self, top: np.ndarray, mean: np.ndarray) -> np.ndarray:
        z = np.concatenate([top, mean], 1) @ self.weights + self.level[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    """The text with WIDTH - 1 zero bytes behind it, in overlapping pieces of BLOCK windows at most."""
    data = np.frombuffer((text or b"\0") + bytes(WIDTH - 1), np.uint8)
    for at in range(0, len(data) - WIDTH + 1, BLOCK):
        yield data[at : at + BLOCK + WIDTH - 1]


def _maxima(net: Network, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Largest responses of each chunk of the pieces, [chunks, FILTERS], and the number of chunks of each piece."""
    data = np.concatenate(pieces)
    found = net.responses(data)
    starts, counts, at = [], [], 0
    for p in pieces:
        own = list(range(at, at + len(p) - WIDTH + 1, CHUNK))
        counts.append(len(own))
        # A cut behind the last window keeps the windows that reach into the next piece out of the last chunk.
        starts += [*own, at + len(p) - WIDTH + 1]
        at += len(p)
    keep = np.ones(len(starts), bool)
    keep[np.cumsum(np.array(counts) + 1) - 1] = False
    starts = np.array(starts)
    inside = starts < len(found)
    return np.maximum.reduceat(found, starts[inside], axis=0)[keep[inside]], np.array(counts)


def pooled(net: Network, texts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Largest and mean chunk features of each text, [texts, FILTERS] each."""
    top, mean, chunks = [], [], []
    held, owner, size = [], [], 0

    def flush() -> None:
        nonlocal held, owner, size
        best, counts = _maxima(net, held)
        whose = np.repeat(owner, counts)
        seen = np.maximum(best + net.bias, 0)
        for i in dict.fromkeys(owner):
            rows = seen[whose == i] if len(set(owner)) == 1 else seen[np.searchsorted(whose, i) : np.searchsorted(whose, i, "right")]
            np.maximum(top[i], rows.max(0), out=top[i])
            mean[i] += rows.sum(0)
            chunks[i] += len(rows)
        held, owner, size = [], [], 0

    for i, text in enumerate(texts):
        top.append(np.zeros(FILTERS))
        mean.append(np.zeros(FILTERS))
        chunks.append(0)
        for piece in _pieces(text):
            held.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= BLOCK:
                flush()
    if held:
        flush()
    return np.array(top).reshape(-1, FILTERS), np.array(mean).reshape(-1, FILTERS) / np.maximum(chunks, 1)[:, None]


def _gradient(net: Network, texts: list[bytes], goal: np.ndarray) -> list[np.ndarray]:
    """Gradient of the mean log loss over a few texts; responses pass it to the windows that they come from."""
    at, into, tops, means = [], [], [], []
    for text in texts:
        data = np.frombuffer((text or b"\0") + bytes(WIDTH - 1), np.uint8)
        best, seen = [], []
        for b, piece in enumerate(_pieces(text)):
            found = net.responses(piece)
            own = np.stack([part.argmax(0) + i * CHUNK for i, part in enumerate(np.split(found, range(CHUNK, len(found), CHUNK)))])
            seen.append(np.maximum(np.take_along_axis(found, own, 0) + net.bias, 0))
            best.append(own + b * BLOCK)
        best, seen = np.concatenate(best), np.concatenate(seen)
        at.append((data, best, seen))
        tops.append(seen.max(0))
        means.append(seen.mean(0))
    top, mean = np.array(tops), np.array(means)
    off = (net.probability(top, mean) - goal) / len(texts)
    d_weights = np.concatenate([top, mean], 1).T @ off
    d_filters, d_bias = np.zeros_like(net.filters), np.zeros_like(net.bias)
    columns = np.arange(FILTERS)
    for (data, best, seen), o in zip(at, off, strict=True):
        into = np.repeat(o * net.weights[None, FILTERS:] / len(best), len(best), 0)
        into[seen.argmax(0), columns] += o * net.weights[:FILTERS]
        into = into * (seen > 0)
        d_bias += into.sum(0)
        for w in range(WIDTH):
            np.add.at(d_filters[w], (data[best + w], columns[None, :]), into)
    return [d_filters, d_bias, d_weights, np.array([off.sum()])]


def train(texts: list[bytes], goal: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit a network by Adam steps over small batches; without texts it says 0.5 everywhere."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    if not len(texts):
        net.weights[:] = 0
    else:
        share = np.clip(goal.mean(), 0.02, 0.98)
        net.level[0] = np.log(share / (1 - share))
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for epoch in range(epochs if len(texts) else 0):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            some = order[b : b + BATCH]
            net.tabulate()
            step += 1
            for p, g, m, v in zip(net.parameters(), _gradient(net, [texts[i] for i in some], goal[some]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.tabulate()
    return net


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Train on at most `sample` whole labelled texts, whose id is allowed, of SAMPLE_BYTES bytes together at most.

    The sizes of the chosen rows are read first, so the driver never holds more text than that. Rows that agree in id
    and text teach once.
    """
    marked = labels.filter(allowed).filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__mark"))
    marked = F.broadcast(marked.orderBy(F.xxhash64("__id"), "__id").limit(sample))
    texts = docs.select(F.col(id_col).alias("id"), whole_text(F.col(text_col)).alias("text")).join(marked, F.col("id") == F.col("__id"))
    keyed = texts.select("id", F.xxhash64("id").alias("key"), F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes"), F.col("__mark").alias("mark"), "text")
    left, chosen = SAMPLE_BYTES, []
    for r in keyed.select("id", "key", "hash", "bytes", "mark").distinct().orderBy("key", "id", "hash").limit(sample).collect():
        if r["bytes"] <= left:
            chosen.append((r["key"], r["hash"]))
            left -= r["bytes"]
    if not chosen:
        return train([], np.zeros(0))
    wanted = docs.sparkSession.createDataFrame(chosen, "wanted_key long, wanted_hash long")
    rows = keyed.join(F.broadcast(wanted), (F.col("key") == F.col("wanted_key")) & (F.col("hash") == F.col("wanted_hash")))
    rows = rows.groupBy("key", "hash").agg(F.min("text").alias("text"), F.max("mark").alias("mark")).orderBy("key", "hash").collect()
    return train([r["text"].encode() for r in rows], np.array([r["mark"] for r in rows], float))


def score(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", score_col: str = "__quality") -> DataFrame:
    """All columns of docs and score_col (one of that name is replaced), the probability (0 to 1) of label 1, from every byte of the text.

    Null texts are empty texts, and an empty text is one window of zero bytes. Rows without a usable label teach
    nothing; with no labelled row at all every score is 0.5. Repeated rows score alike; no rows give no rows.
    """
    net = fit(docs, labels, allowed, sample, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(net.parameters())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Network(*shared.value)
        own.tabulate()
        for texts in batches:
            yield pd.Series(own.probability(*pooled(own, (t.encode() for t in texts))) if len(texts) else [], dtype="float64")

    return docs.withColumn(score_col, F.pandas_udf(run, "double")(whole_text(F.col(text_col))))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; labels of fold 0 are held out."""
    held_out = in_fold(F.col("doc_id"), 0)
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("__quality").alias("score"), (F.col("__quality") >= 0.3).cast("int").alias("predicted"))

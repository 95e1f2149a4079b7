"""A hidden Markov language model trained by Baum-Welch over partitions, and exact scores by scaled forward recursion.

The hidden states emit word classes (a hash of a word's last bytes, so a bounded number) and a class emits its words
by smoothed corpus counts:

    P(text) = P_hmm(classes of the text) * product of P(word | class of the word)

States and classes fit into a small broadcast model; the word counts do not, and stay a distributed table. The most
frequent words of it, a bounded number, are looked up map-side and only the rest goes through a join, where no
single word is frequent any more. Expected counts of each Baum-Welch step are summed in the tasks, then over tasks by a
shuffle on the parameter, and only the new parameters reach the driver.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold, spool, table, whole_text

STATES = 8
#: Word classes, besides the one of the end token.
CLASSES = 4096
#: A word's class hashes this many of its last bytes.
SUFFIX = 5
STEPS = 4
SMOOTH = 0.5
#: Words whose counts are looked up map-side, at most; longer ones than LONG bytes are left to the join.
FREQUENT, LONG = 65_536, 64
#: Distinct words that a task counts before it hands them on, or numbers before it starts anew.
HELD = 200_000
#: Tokens that a task puts through the recursion at once, in training and in scoring.
TOKENS, SCORED = 800_000, 2_000_000
#: Training walks longer texts in blocks of this many tokens side by side; what enters and leaves each block is computed
#: exactly before, so the counts are those of the whole text.
BLOCK = 2_048


def word_class(word: bytes) -> int:
    """The class of a word; the end token, the empty word, has a class of its own."""
    return zlib.crc32(word[-SUFFIX:]) % CLASSES if word else CLASSES


@dataclass
class Model:
    """start [K], move [K, K], emit [K, classes + 1]: probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(mass: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
    """Sticky states whose emissions are the class shares, each bent its own seeded way."""
    noise = np.random.default_rng(seed).normal(0.0, 1.0, (states, len(mass)))
    emit = (mass + 1e-12) * np.exp(noise)
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _by_step(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all sequences, step after step, longest sequence first; the order; how many sequences each step has."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([sequences[i] for i in order])
    step = np.arange(len(flat)) - np.repeat(np.cumsum(lengths[order]) - lengths[order], lengths[order])
    return flat[np.argsort(step, kind="stable")], order, np.bincount(step)


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of the likelihood of each (non-empty) sequence."""
    flat, order, active = _by_step(sequences)
    move, emit, one = model.move, np.ascontiguousarray(model.emit.T), np.ones((len(model.move), 1))
    total, at, alpha = np.zeros(len(sequences)), 0, model.start[None, :]
    for n in active:
        seen = emit[flat[at : at + n]]
        alpha = (alpha if not at else alpha[:n] @ move) * seen
        scale = alpha @ one
        alpha = alpha / scale
        total[:n] += np.log10(scale[:, 0])
        at += n
    out = np.empty(len(sequences))
    out[order] = total
    return out


def borders(model: Model, sequences: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Long sequences in blocks of BLOCK symbols, and the recursion at their borders.

    Returns the blocks, sequence after sequence, the forward values before each (zeros before the first of a sequence) and
    the backward values behind each, of any scale. A block is a product of matrices, one for each symbol; the products of
    all blocks grow side by side, and only their borders are walked one after another.
    """
    k = len(model.start)
    blocks = [s[i : i + BLOCK] for s in sequences for i in range(0, len(s), BLOCK)]
    flat, order, active = _by_step(blocks)
    emit, product = np.ascontiguousarray(model.emit.T), np.tile(np.eye(k), (len(blocks), 1, 1))
    at = 0
    for t, n in enumerate(active):
        now = product[:n]
        if t:
            now = (now.reshape(-1, k) @ model.move).reshape(n, k, k)
        product[:n] = now * emit[flat[at : at + n]][:, None, :]
        at += n
        if t % 16 == 15:
            product[:n] /= product[:n].sum((1, 2), keepdims=True)
    products = np.empty_like(product)
    products[order] = product
    before, behind = np.zeros((len(blocks), k)), np.ones((len(blocks), k))
    at = 0
    for s in sequences:
        n = -(-len(s) // BLOCK)
        now = model.start @ products[at]
        for i in range(at + 1, at + n):
            before[i] = now / now.sum()
            now = before[i] @ model.move @ products[i]
        for i in range(at + n - 2, at - 1, -1):
            behind[i] = model.move @ (products[i + 1] @ behind[i + 1])
            behind[i] /= behind[i].sum()
        at += n
    return blocks, before, behind


def expected(model: Model, sequences: list[np.ndarray]) -> Model:
    """Expected counts of starts, moves and emissions over the (non-empty) sequences."""
    k = len(model.start)
    short = [s for s in sequences if len(s) <= BLOCK]
    blocks, before, behind = borders(model, long) if (long := [s for s in sequences if len(s) > BLOCK]) else ([], np.zeros((0, k)), np.ones((0, k)))
    flat, order, active = _by_step(short + blocks)
    before, behind = np.vstack([np.zeros((len(short), k)), before])[order], np.vstack([np.ones((len(short), k)), behind])[order]
    opens = ~before.any(1)  # parts that begin a sequence; the others follow the block before them
    move, emit = model.move, np.ascontiguousarray(model.emit.T)
    back_move, one = np.ascontiguousarray(move.T), np.ones((k, 1))
    begin = np.concatenate(([0], np.cumsum(active)))
    seen = emit[flat]  # divided by each step's scale on the way forward
    weight = np.empty_like(seen)  # the forward values, then times the backward ones
    now = np.where(opens[:, None], model.start[None, :], before @ move)
    for t, n in enumerate(active):
        here = seen[begin[t] : begin[t] + n]
        now = np.multiply(now if not t else now[:n] @ move, here, out=weight[begin[t] : begin[t] + n])
        scale = now @ one  # a product, as sums over so short an axis are slow
        now /= scale
        here /= scale
    moves = np.zeros_like(model.move)
    beta = np.ones((0, k))
    for t in range(len(active) - 1, -1, -1):
        at, n = slice(begin[t], begin[t] + active[t]), active[t]
        if len(beta) < n:  # parts that end here: their backward values, scaled so that they and the forward ones give 1
            last = weight[begin[t] + len(beta) : begin[t] + n]
            tail = behind[len(beta) : n]
            beta = np.concatenate([beta, tail / ((last * tail) @ one)])
        weight[at] *= beta
        seen[at] *= beta
        moves += (weight[begin[t - 1] : begin[t - 1] + n] if t else before).T @ seen[at]
        beta = seen[at] @ back_move
    emitted = np.stack([np.bincount(flat, weights=weight[:, j], minlength=model.emit.shape[1]) for j in range(k)])
    return Model(weight[: active[0]][opens].sum(0), moves * model.move, emitted)


def _runs(sequences: Iterator[np.ndarray], tokens: int, apart: int | None = None) -> Iterator[list[np.ndarray]]:
    """Sequences in lists of about so many tokens; those longer than `apart` in lists of their own, in their order otherwise."""
    held, size = ([], []), [0, 0]
    for s in sequences:
        kind = int(apart is not None and len(s) > apart)
        held[kind].append(s)
        size[kind] += len(s)
        if size[kind] >= tokens:
            yield held[kind][:]
            held[kind].clear()
            size[kind] = 0
    yield from (h for h in held if h)


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, cls, c) over docs: how often each token occurs; the end token is the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(map(word_class, words), pa.int32(), size=len(words)), pa.array(counts.values(), pa.int64(), size=len(words))], ["token", "cls", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(text.as_py().lower().split())
                counts[b""] += 1
                if len(counts) > HELD:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    parts = docs.select(whole_text(F.col(text_col)).alias("text")).mapInArrow(run, "token string, cls int, n long")
    return parts.groupBy("token", "cls").agg(F.sum("n").alias("c"))


class Codes(dict):
    """Numbers of words, given out as they are met, after those of the given words; words and their classes by number."""

    def __init__(self, first: Iterable[bytes]):
        super().__init__()
        self.words: list[bytes] = []
        self.classes = array("H")
        for word in first:
            self[word]

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.words.append(word)
        self.classes.append(word_class(word))
        return code


def read_texts(docs: DataFrame, frequent: dict[bytes, int], id_col: str, text_col: str, held_out) -> DataFrame:
    """One row for each text: its classes in order, the sums over its frequent tokens, and its other tokens.

    Columns: uid, doc_id, held_out, n_tokens, n_known, log_counts, classes (uint16 in a binary), rare, rare_n.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.log10(np.fromiter(shared.value.values(), np.float64, len(shared.value)) + 0.5)
        codes = Codes(shared.value)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for text in batch.column(2).cast(pa.binary()):
                words = text.as_py().lower().split()
                words.append(b"")
                if len(codes) > HELD + len(logs):
                    codes = Codes(shared.value)
                seen = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
                known = seen[seen < len(logs)]
                rare, rare_n = np.unique(seen[seen >= len(logs)], return_counts=True) if len(known) < len(seen) else (known[:0], known[:0])
                rows.append((uid, len(words), len(known), float(logs[known].sum()), np.frombuffer(codes.classes, np.uint16)[seen].tobytes(), [codes.words[i] for i in rare], rare_n))
                uid += 1
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            arrays[5] = arrays[5].cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([arrays[0], batch.column(0), batch.column(1), *arrays[1:]], ["uid", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", "classes", "rare", "rare_n"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), whole_text(F.col(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_counts double, classes binary, rare array<string>, rare_n array<int>")


def baum_welch(texts: DataFrame, model: Model, steps: int = STEPS, smooth: float = SMOOTH) -> Model:
    """The model after so many steps over the column classes of all rows of texts."""
    context = texts.sparkSession.sparkContext
    mass = model.emit.mean(0)
    k, width = model.emit.shape
    for _ in range(steps):
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + k * k + k * width)
            texts = (np.frombuffer(t.as_py(), np.uint16) for b in batches for t in b.column(0))
            for some in _runs(texts, TOKENS, BLOCK):
                part = expected(shared.value, some)
                total += np.concatenate([part.start, part.move.ravel(), part.emit.ravel()])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["parameter", "n"])

        # Summed to a precision that does not depend on the order of the tasks, so reruns agree.
        parts = texts.select("classes").mapInArrow(run, "parameter int, n double").withColumn("n", F.round(F.col("n") * 2**30).cast("decimal(38,0)"))
        sums = np.zeros(k + k * k + k * width)
        found = parts.groupBy("parameter").agg(F.sum("n").cast("double").alias("n")).toArrow()  # one row for each parameter of the model
        sums[found.column("parameter").to_numpy()] = found.column("n").to_numpy() / 2**30
        start, move, emit = sums[:k] + smooth, sums[k : k + k * k].reshape(k, k) + smooth, sums[k + k * k :].reshape(k, width) + smooth * width * mass
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    return model


def score(docs: DataFrame, held_out, states: int = STATES, steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows of docs that held_out (a boolean column) leaves, score all rows by the trained model.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, for each row of docs. Words are
    lower-cased (A-Z) between ASCII white space and followed by one end token, so null, empty and blank texts have
    one token. base_score is the smoothed unigram log10 probability; score is the model's, of the same tokens, every
    token that training has not seen counting as its class's unknown word. Repeated rows each get their row; without
    training rows every token is unknown and all classes are alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = spool(word_counts(docs.filter(~held_out), id_col, text_col), "words")
    by_class = counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()  # one row for each class at most
    size, kinds = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    size[by_class.column("cls").to_numpy()], kinds[by_class.column("cls").to_numpy()] = by_class.column("n").to_numpy(), by_class.column("v").to_numpy()
    n, v = int(size.sum()), int(kinds.sum())
    top = counts.filter(F.octet_length("token") <= LONG).orderBy(F.desc("c"), "token").limit(FREQUENT).select("token", "c").toArrow()
    frequent = dict(zip(top.column("token").cast(pa.binary()).to_pylist(), top.column("c").to_pylist(), strict=True))
    texts = spool(read_texts(docs, frequent, id_col, text_col, held_out), "texts")

    rare = texts.select("uid", F.inline(F.arrays_zip(F.col("rare").alias("token"), F.col("rare_n").alias("n"))))
    weighed = rare.join(counts.select("token", "c"), "token", "left").select("uid", "n", F.coalesce("c", F.lit(0)).alias("c"))
    rest = weighed.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("more_logs"))

    share = size + 0.5 * (kinds + 1)
    model = baum_welch(texts.filter("not held_out"), first_model(share / share.sum(), states), steps)
    shared = spark.sparkContext.broadcast((model, np.log10(share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, log_share = shared.value
        for batch in batches:
            seqs = [np.frombuffer(t.as_py(), np.uint16) for t in batch.column(1)]
            found = [forward(hmm, some) for some in _runs(iter(seqs), SCORED)]
            logs = np.concatenate(found) - np.fromiter((log_share[s].sum() for s in seqs), np.float64, len(seqs)) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(logs)], ["uid", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", "logs"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.select("uid", "classes", "doc_id", "held_out", "n_tokens", "n_known", "log_counts").mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_counts double, logs double")
    log_counts = F.col("log_counts") + F.coalesce("more_logs", F.lit(0.0))
    return scored.join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"), (log_counts + F.col("logs")).alias("score"),
    )


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents by a model of those outside fold 1."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, in_fold(F.col("doc_id"), 1))

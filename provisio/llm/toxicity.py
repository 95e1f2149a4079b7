"""Toxicity by a noisy channel: restore obfuscated words by Viterbi decoding, then score the restored text.

Leetspeak, letters spaced out and letters repeated are a channel between the word meant and the token seen. A character
bigram model of the whole corpus says which letters follow each other, the channel says what a character may stand
for, and the cheapest path through the lattice of readings is the word restored. The score is a logistic curve over two
sums of the restored text: the log-odds of its clearly toxic words, and the mean log-odds of all its words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold, only, spool, table, unused, whole_text

#: Labelled rows that the word weights and the curve are fitted on, at most (the smallest by a hash of their id).
SAMPLE = 8_192
#: Texts of the usual mix that every word is taken to have been in besides, so rare words say little.
PRIOR = 2.0
#: Log-odds beyond which a word says much. Such words are looked for in spaced-out and cut words too; their list is
#: broadcast, so it has a bound (the weightiest), beyond which words still count by their bucket.
STRONG, LISTED = 2.5, 65_536
#: Words without evidence that every text is taken to have besides, so the mean of a few words says little.
SHORT = 5
#: Parts of the sample for the fit of the curve.
FOLDS = 5
#: Buckets that hold the weights of all other words.
BUCKETS = 262_144
#: Distinct tokens whose reading a task keeps at hand.
HELD = 300_000
#: A word cut into more than two pieces is looked for where its pieces have this many bytes at most, or are letters alone.
SHORT_PIECE, PIECES = 3, 8
#: A word in pieces has this many letters at least; so many of a token's letters can be hidden.
PIECED_WORD, HIDDEN_LETTERS = 4, 2

#: The letters a character may stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
#: Characters that only separate, and those that hide any letter.
BETWEEN, HIDES = ".-_~'`,:/\\^=", "*#%"
#: Log10 probabilities of the channel: a sign for a letter, a letter said again, a separator, a hidden letter.
SIGN, AGAIN, GAP, HIDDEN = math.log10(0.05), math.log10(0.3), math.log10(0.2), math.log10(0.02)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the character model: 0 for whatever ends a word, 1-26 the letters, 27 any byte beyond ASCII.
SYMBOLS = 28

_EDGES = BETWEEN + HIDES + "!?;\"()[]{}<>|&+«»¿¡…–—"
_ODD = re.compile(r"[^a-z\x80-\U0010FFFF]|(.)\1\1", re.S)
_RUN = re.compile(r"(.)\1+", re.S)
_SIGNS = re.compile(f"[{re.escape(''.join(READINGS) + HIDES)}]")
_LETTER, _NO_LETTER = re.compile("[a-z]"), re.compile(r"[^a-z\x80-\U0010FFFF]")
_FIRST, _LAST = re.compile("^[a-z]*"), re.compile("[a-z]*$")
_DOUBLE = re.compile(r"(.)\1", re.S)
_LONG_RUN = re.compile(r"(.)\1{2,}", re.S)


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log10 P(next symbol | symbol) over all texts, with half a count added; [SYMBOLS, SYMBOLS]."""
    codes = np.zeros(256, np.int16)
    codes[97:123] = codes[65:91] = np.arange(1, 27)
    codes[128:] = 27

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                s = codes[np.frombuffer(b"\n" + text.as_py() + b"\n", np.uint8)]
                total += np.bincount(s[:-1] * np.int16(SYMBOLS) + s[1:], minlength=SYMBOLS * SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SYMBOLS * SYMBOLS), pa.int32()), pa.array(total)], ["pair", "n"])

    parts = docs.select(whole_text(F.col(text_col)).alias("text")).mapInArrow(run, "pair int, n long")
    found = parts.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # 784 rows
    counts = np.full(SYMBOLS * SYMBOLS, 0.5)
    counts[found.column("pair").to_numpy()] += found.column("n").to_numpy()
    counts = counts.reshape(SYMBOLS, SYMBOLS)
    return np.log10(counts / counts.sum(1, keepdims=True))


def decode(token: str, model: list[list[float]]) -> str:
    """The likeliest word behind a lower-case token: Viterbi over (last letter read), letter by letter."""
    paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # words as (word before, letter): no copies
    for ch in token:
        step: dict[int, tuple[float, tuple | None]] = {}

        def reach(state: int, cost: float, word: tuple | None) -> None:
            if state not in step or cost > step[state][0]:
                step[state] = (cost, word)

        own = ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch > "\x7f" and ch not in READINGS else 0
        read = [(own, 0.0, ch)] if own else [(ord(x) - 96, SIGN, x) for x in READINGS.get(ch, "")]
        if ch in HIDES:
            read += [(k + 1, HIDDEN, x) for k, x in enumerate(LETTERS)]
        for last, (cost, word) in paths.items():
            for state, channel, letter in read:
                reach(state, cost + channel + model[last][state], (word, letter))
                if state == last and word is not None and word[1] == letter:
                    reach(state, cost + min(channel, AGAIN), word)
            if not read or ch in BETWEEN or ch in HIDES:
                reach(last, cost + GAP, word)
        paths = step
    ends = [(cost + model[last][0], word) for last, (cost, word) in paths.items()]
    best = max((cost for cost, _ in ends), default=0.0)
    return max((_said(word) for cost, word in ends if cost == best), default="")


def _said(word: tuple | None) -> str:
    letters = []
    while word is not None:
        word, letter = word
        letters.append(letter)
    return "".join(reversed(letters))


def restore(token: str, model: list[list[float]]) -> str:
    """A lower-case token without its outer marks, decoded if it looks obfuscated, else as it is."""
    core = token.strip(_EDGES)
    core = re.sub(r"^[$@]{2,}|[$@]{2,}$", "", core) if core[-1:] in "$@" or core[:1] in "$@" else core
    if not _ODD.search(core) or not any("a" <= c <= "z" for c in core):
        return core
    return decode(_LONG_RUN.sub(r"\1\1", core), model)


def squeeze(word: str) -> str:
    """The word with each run of a letter as one letter: repetition can't tell squeezed words apart."""
    return _RUN.sub(r"\1", word)


def join(a: str, b: str) -> str:
    """Two squeezed words as one squeezed word."""
    return a + b[1:] if a and b and a[-1] == b[0] else a + b


def restored(token: str, model: list[list[float]]) -> str:
    """squeeze(restore(token)). Where no character can be read as another one, the best path just drops what is no letter,
    and merges at most what squeezing merges too."""
    core = token.strip(_EDGES)
    if core.isalpha() or not _LETTER.search(core):
        return squeeze(core)
    return squeeze(restore(token, model) if _SIGNS.search(core) else _NO_LETTER.sub("", core))


def signs_read(token: str, model: list[list[float]]) -> str:
    """The squeezed word that a token of signs alone, without a letter, stands for; empty for other tokens.

    Most such tokens are numbers, so the reading says something only if it is a word that is looked for.
    """
    core = token.strip(_EDGES)
    if any("a" <= c <= "z" for c in core) or not any(c in READINGS for c in core):
        return ""
    return squeeze(decode(_LONG_RUN.sub(r"\1\1", core), model))


def _spaced(tokens: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of three or more one-character tokens: letters that were spaced out."""
    i = 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and len(tokens[j]) == 1:
            j += 1
        if j - i >= 3:
            yield i, j
        i = max(j, i + 1)


def restore_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the obfuscated tokens of the text replaced by the words restored; other tokens stay, white space becomes one space.

    Null texts stay null.
    """
    model = character_model(docs, text_col).tolist()

    def clean(text: str) -> str:
        tokens, out, at = text.split(), [], 0
        for i, j in [*_spaced(tokens), (len(tokens), len(tokens))]:
            for t in tokens[at:i]:
                low = _lower(t)
                word = restore(low, model)
                out.append(t if word == low.strip(_EDGES) else word)
            if i < j:
                out.append(restore(_lower("".join(tokens[i:j])), model))
            at = j
        return " ".join(out)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(clean, na_action="ignore")

    return docs.withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col)))


def _lower(text: str) -> str:
    return text.encode().lower().decode()


@dataclass
class Classifier:
    """listed: weights of the words that say much; table: those of all others by a hash of the word; slopes, level: the curve."""

    listed: dict[str, float]
    table: np.ndarray
    slopes: np.ndarray
    level: float

    def weight(self, word: str) -> float:
        found = self.listed.get(word)
        return float(self.table[zlib.crc32(word.encode()) % BUCKETS]) if found is None else found

    def probability(self, strong: np.ndarray, mean: np.ndarray) -> np.ndarray:
        z = np.stack([np.log1p(strong), mean], 1) @ self.slopes + self.level
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Slopes and level of the logistic curve, by Newton steps; the prior is ten texts without evidence, one of them toxic."""
    n, d = x.shape
    x1 = np.hstack([np.vstack([x, np.zeros((2, d))]), np.ones((n + 2, 1))])
    goal, mass = np.append(y, [0.0, 1.0]), np.append(np.ones(n), [9.0, 1.0])
    w, held = np.append(np.zeros(d), -2.0), ridge * np.append(np.ones(d), 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        push = x1.T @ (mass * (goal - p)) - held * w
        bend = (x1 * (mass * p * (1 - p))[:, None]).T @ x1 + np.diag(held + 1e-5)
        move = np.linalg.solve(bend, push)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return w[:d], float(w[d])


def rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """logistic() without the columns whose slope is negative: evidence for a label never counts against it."""
    use = np.ones(x.shape[1], bool)
    while True:
        slopes, level = logistic(x[:, use], y)
        out = np.zeros(x.shape[1])
        out[use] = slopes
        if (out >= 0).all():
            return out, level
        use &= out >= 0


def _odds(bad: Column, good: Column, share: float) -> Column:
    """Log-odds of a word held by so many toxic and clean texts, drawn towards none by PRIOR texts of the usual mix."""
    return F.log((bad + PRIOR * share) / (good + PRIOR * (1 - share))) - math.log(share / (1 - share))


def read_words(tokens: list[str], model: list[list[float]], cache: dict[str, str]) -> set[str]:
    """The distinct restored words of a text, squeezed, without empty ones."""
    found = {squeeze(restore("".join(tokens[i:j]), model)) for i, j in _spaced(tokens)}
    for t in set(tokens):
        if t not in cache:
            if len(cache) > HELD:
                cache.clear()
            cache[t] = restored(t, model)
        found.add(cache[t])
    return found - {""}


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, allowed: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """Weights of all words and the curve, from at most `sample` labelled rows whose id is allowed.

    Texts are dealt into FOLDS parts. The curve is fitted on evidence that the other parts' counts give, so a word that
    only the text itself speaks for counts for nothing; the weights come from all counts in the end.
    """
    marked = labels.filter(allowed).filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__mark"))
    marked = F.broadcast(marked.orderBy(F.xxhash64("__id"), "__id").limit(sample))
    rows = docs.select(F.col(id_col).alias("id"), whole_text(F.col(text_col)).alias("text")).join(marked, F.col("id") == F.col("__id"))
    rows = rows.groupBy(F.xxhash64("text").alias("key")).agg(F.max("__mark").alias("mark"), F.min("text").alias("text"))  # copies teach once
    near = model.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for batch in batches:
            words = [sorted(read_words(_lower(text.as_py()).split(), near, cache)) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], ["key", "mark", "words"])

    texts = spool(rows.select("key", "mark", "text").mapInArrow(run, "key long, mark int, words array<string>").withColumn("fold", F.pmod("key", F.lit(FOLDS)).cast("int")), "read")
    by_fold = {r["fold"]: (r["bad"], r["n"]) for r in texts.groupBy("fold").agg(F.sum("mark").alias("bad"), F.count(F.lit(1)).alias("n")).collect()}
    bad, n = (sum(r[i] for r in by_fold.values()) for i in (0, 1))
    if not 0 < bad < n:
        return Classifier({}, np.zeros(BUCKETS), np.zeros(2), math.log((bad + 0.1) / (n - bad + 0.9)))
    share = (bad + 1) / (n + 10)
    pairs = texts.select("key", "fold", "mark", F.explode("words").alias("word"))
    by_part = [F.count_if((F.col("fold") == f) & (F.col("mark") == m)).alias(f"n{m}_{f}") for m in (0, 1) for f in range(FOLDS)]
    counts = pairs.groupBy("word").agg(*by_part)
    parts = [F.array(*(F.col(f"n{m}_{f}") for f in range(FOLDS))) for m in (0, 1)]
    counts = spool(counts.select("word", parts[1].alias("bad_in"), parts[0].alias("good_in")), "counts")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    counts = counts.withColumns({"bad": total("bad_in"), "good": total("good_in")})

    own = lambda c: F.element_at(c, F.col("fold") + 1)
    other = _odds(F.col("bad") - own("bad_in"), F.col("good") - own("good_in"), share)
    told = pairs.join(counts, "word").withColumn("w", other).groupBy("key").agg(F.sum(F.greatest(F.col("w") - STRONG, F.lit(0.0))).alias("strong"), (F.sum("w") / (F.count(F.lit(1)) + SHORT)).alias("mean"))
    told = texts.select("key", "mark").join(told, "key", "left").select("mark", F.coalesce("strong", F.lit(0.0)).alias("strong"), F.coalesce("mean", F.lit(0.0)).alias("mean")).toArrow()  # `sample` rows at most
    x = np.stack([np.log1p(told.column("strong").to_numpy()), told.column("mean").to_numpy()], 1)
    order = np.lexsort((told.column("mark").to_numpy(), x[:, 1], x[:, 0]))  # so that sums don't depend on the order of tasks
    slopes, level = rising(np.round(x[order], 9), told.column("mark").to_numpy()[order].astype(float))

    weighed = counts.select("word", "bad", "good", _odds(F.col("bad"), F.col("good"), share).alias("weight"))
    best = weighed.filter(F.col("weight") > STRONG).orderBy(F.desc("weight"), "word").limit(LISTED).select("word", "weight").toArrow()
    listed = dict(zip(best.column("word").to_pylist(), best.column("weight").to_pylist(), strict=True))
    beyond = F.col("weight") <= STRONG
    if len(listed) == LISTED:
        last, least = list(listed.items())[-1]
        beyond |= (F.col("weight") < least) | ((F.col("weight") == least) & (F.col("word") > last))
    rest = weighed.filter(beyond).groupBy((F.crc32(F.col("word").cast("binary")) % BUCKETS).alias("bucket")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rest = rest.select("bucket", _odds(F.col("bad"), F.col("good"), share).alias("weight")).toArrow()  # one row for each bucket at most
    table_ = np.zeros(BUCKETS)
    table_[rest.column("bucket").to_numpy()] = np.minimum(rest.column("weight").to_numpy(), STRONG)
    return Classifier(listed, table_, slopes, level)


class Reader:
    """Reads the texts of a task: numbers its tokens and words, so that a text's evidence is sums over arrays."""

    def __init__(self, classifier: Classifier, model: list[list[float]]):
        self.model, self.listed, self.table = model, classifier.listed, classifier.table.tolist()
        self.starts = {w[:k] for w in self.listed for k in range(len(w) + 1)}
        self.ends = {w[k:] for w in self.listed for k in range(len(w) + 1)}
        self.any_listed = re.compile("|".join(sorted(map(re.escape, self.listed), key=len, reverse=True))) if self.listed else None
        self.forget()

    def forget(self) -> None:
        self.tokens: dict[bytes, int] = {}
        self.joined: dict[bytes, str] = {}
        self.words: dict[str, int] = {"": 0}
        self.names = [""]
        self.word, self.kind, self.plain, self.weight = np.zeros(1024, np.int64), np.zeros(1024, np.int8), np.zeros(1024, bool), np.zeros(1024)
        self.short = np.zeros(1024, bool)

    def meant(self, text: str) -> str:
        """The word behind a token; one of signs alone is read as a word only if that word is listed."""
        core = text.strip(_EDGES)
        if core.isalpha():
            return _RUN.sub(r"\1", core) if _DOUBLE.search(core) else core
        if _LETTER.search(core):
            return self.uncovered(core) or restored(text, self.model)
        word = signs_read(text, self.model)
        return word if word in self.listed else squeeze(core)

    def uncovered(self, core: str) -> str:
        """The weightiest listed word that a token with a hidden letter or two can be; empty if none."""
        spots = [i for i, c in enumerate(core) if c in HIDES]
        if not 0 < len(spots) <= HIDDEN_LETTERS or len(core) < PIECED_WORD:
            return ""
        found = {""}
        for letters in product(LETTERS, repeat=len(spots)):
            said = list(core)
            for i, letter in zip(spots, letters, strict=True):
                said[i] = letter
            word = "".join(said)
            found.add(squeeze(word) if word.isalpha() else restored(word, self.model) if len(spots) == 1 else "")
        return max(found, key=lambda w: (self.listed.get(w, 0.0), w)) if not found.isdisjoint(self.listed) else ""

    def number(self, tokens: set[bytes]) -> None:
        """Number new tokens. Kinds: 0 plain, 1 a listed word, 2 one character, 3 the start of a listed word."""
        first_token, first_word = len(self.tokens), len(self.names)
        word, kind, plain, weight, short = [], [], [], [], []
        for token in tokens:
            text = token.decode()
            if letters := token.isalpha():
                name = _RUN.sub(r"\1", text) if _DOUBLE.search(text) else text
            else:
                name = self.meant(text)
            at = self.words.get(name)
            if at is None:
                at = self.words[name] = len(self.names)
                self.names.append(name)
                own = self.listed.get(name)
                weight.append(self.table[zlib.crc32(name.encode()) % BUCKETS] if own is None else own)
            self.tokens[token] = len(self.tokens)
            word.append(at)
            kind.append(1 if name in self.listed else 2 if len(text) == 1 else 3 if name and name in self.starts else 0)
            plain.append(letters)
            short.append(len(token) <= SHORT_PIECE)
        while len(self.word) < len(self.tokens):
            more = len(self.word)
            self.word, self.kind, self.plain, self.short = (np.append(x, np.zeros(more, x.dtype)) for x in (self.word, self.kind, self.plain, self.short))
        while len(self.weight) < len(self.names):
            self.weight = np.append(self.weight, np.zeros(len(self.weight)))
        new = slice(first_token, len(self.tokens))
        self.word[new], self.kind[new], self.plain[new], self.short[new] = word, kind, plain, short
        self.weight[first_word : len(self.names)] = weight

    def evidence(self, text: bytes) -> tuple[float, float]:
        """(weights beyond STRONG summed, mean weight) over the distinct words of a text and the listed words pieced together in it."""
        tokens = text.lower().split()
        if len(self.tokens) > HELD or len(self.joined) > HELD:
            self.forget()
        if new := set(tokens).difference(self.tokens):
            self.number(new)
        ids = np.fromiter(map(self.tokens.__getitem__, tokens), np.int64, len(tokens))
        mine = np.unique(self.word[ids])
        mine = mine[mine > 0]
        own = self.weight[mine]
        strong, total, n = np.maximum(own - STRONG, 0).sum(), own.sum(), len(own)
        kinds = self.kind[ids]
        if self.listed and (kinds >= 2).any():
            have = set(mine.tolist())
            for w in sorted(self.pieced(tokens, ids, kinds)):
                if self.words.get(w, -1) not in have:
                    strong, total, n = strong + self.listed[w] - STRONG, total + self.listed[w], n + 1
        return float(strong), float(total / (n + SHORT))

    def pieced(self, tokens: list[bytes], ids: np.ndarray, kinds: np.ndarray) -> set[str]:
        """Listed words that were spaced out or cut into pieces."""
        words: set[str] = set()
        one = kinds == 2
        runs = np.flatnonzero(one[:-2] & one[1:-1] & one[2:])
        if len(runs):
            first = np.concatenate(([True], np.diff(runs) > 1))
            last = np.concatenate((np.diff(runs) > 1, [True]))
            for i, j in zip(runs[first], runs[last] + 3, strict=True):
                run = b"".join(tokens[i:j]).decode()
                words.update(self.any_listed.findall(squeeze(restore(run, self.model))))
                if (word := signs_read(run, self.model)) in self.listed:
                    words.add(word)
        both = (kinds[:-1] >= 2) & (kinds[1:] != 1)
        letters = self.plain[ids]
        easy = letters[:-1] & letters[1:]
        # Two tokens of letters alone are read as their squeezed words, joined; each distinct pair is looked at once.
        # One that goes on to begin a listed word is followed over the tokens behind it.
        at = np.flatnonzero((kinds[:-1] >= 2) & easy)
        if len(at):
            pairs, where = np.unique((self.word[ids[at]] << 32) | self.word[ids[at + 1]], return_inverse=True)
            for n, (a, b) in enumerate(zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True)):
                joined = join(self.names[a], self.names[b])
                if joined not in self.starts:
                    continue
                if joined in self.listed and self.names[b] not in self.listed:
                    words.add(joined)
                for i in at[where == n].tolist():
                    words.update(self.followed(joined, ids[i + 2 : i + PIECES]))
        # Short tokens with signs among them are read through the lattice of their characters together.
        small = self.short[ids]
        three = small[:-2] & small[1:-1] & small[2:] & ~(letters[:-2] & letters[1:-1] & letters[2:])
        for i in np.flatnonzero(three & ((kinds[:-2] >= 1) | ~letters[:-2])).tolist():
            for j in range(i + 3, min(i + PIECES, len(tokens)) + 1):
                if not small[j - 1]:
                    break
                if len(word := self.read(b"".join(tokens[i:j]))) >= PIECED_WORD and word in self.listed:
                    words.add(word)
        for i in np.flatnonzero(both & ~easy).tolist():
            if (word := self.read(tokens[i] + tokens[i + 1])) in self.listed:
                words.add(word)
        return words

    def read(self, pieces: bytes) -> str:
        """The word that joined tokens stand for, as far as they begin and end like a listed word; else empty."""
        found = self.joined.get(pieces)
        if found is None:
            text = pieces.decode()
            core = text.strip(_EDGES)
            # Letters are read as themselves, so what is read begins and ends like the token.
            like = squeeze(_FIRST.search(core)[0]) in self.starts and squeeze(_LAST.search(core)[0]) in self.ends
            found = self.joined[pieces] = self.meant(text) if like else ""
        return found

    def followed(self, begun: str, ids: np.ndarray) -> Iterator[str]:
        """Listed words of PIECED_WORD letters or more that tokens of letters spell on from a beginning, piece by piece."""
        for token in ids.tolist():
            if not self.plain[token]:
                return
            begun = join(begun, self.names[self.word[token]])
            if begun not in self.starts:
                return
            if begun in self.listed and len(begun) >= PIECED_WORD:
                yield begun


def score(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", score_col: str = "__toxic") -> DataFrame:
    """All columns of docs and score_col, the probability (0 to 1) that the text is toxic; a column of that name is replaced.

    The character model learns from all texts; weights and curve from labelled rows whose id is allowed, no more than
    `sample`. Every distinct restored word of a text counts by its weight. Null, empty and blank texts have the score of
    a text without evidence. Without labelled rows, or with labels of one kind alone, every text has the same score.
    Repeated rows score alike; an empty table gives no rows.
    """
    model = character_model(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((fit(docs, labels, model, allowed, sample, id_col, text_col, label_col), model.tolist()))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classifier, near = shared.value
        reader = Reader(classifier, near)
        for texts in batches:
            found = np.array([reader.evidence(t.encode()) for t in texts]).reshape(-1, 2)
            yield pd.Series(classifier.probability(found[:, 0], found[:, 1]))

    return docs.withColumn(score_col, F.pandas_udf(run, "double")(whole_text(F.col(text_col))))


def keep_clean(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose score is 0.5 or more; its columns unchanged."""
    allowed = in_fold(F.col(id_col), 0) == F.lit(False) if allowed is None else allowed
    own = unused(docs, "__toxic")
    return only(score(docs, labels, allowed, id_col=id_col, text_col=text_col, score_col=own).filter(F.col(own) < 0.5), docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; labels of fold 0 are held out."""
    held_out = in_fold(F.col("doc_id"), 0)
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("__toxic").alias("score"), (F.col("__toxic") >= 0.5).cast("int").alias("predicted"))

"""Toxicity: decoding, held-out accuracy, planted texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from provisio.llm import toxicity as X
from provisio.llm.common import in_fold


@pytest.fixture(scope="module")
def model(spark):
    texts = ["The operator is an idiot, a moron and a loser. Stupid trash is worthless. Note the meeting is at noon. " * 5]
    return X.character_model(spark.createDataFrame([(t,) for t in texts], "text string")).tolist()


@pytest.mark.parametrize(("seen", "meant"), [("1d10t", "idiot"), ("m0r0n", "moron"), ("i.d.i.o.t", "idiot"), ("l0ser!!", "loser"), ("$tup1d", "stupid"), ("plain", "plain"), ("3.14", "3.14"), ("it's", "its")])
def test_restore(model, seen, meant):
    assert X.restore(seen, model) == meant


def test_repetition_is_squeezed(model):
    assert X.squeeze(X.restore("idiiiiioooot", model)) == "idiot"


def test_decode_is_the_best_path(model):
    """Viterbi against all readings of a short token."""
    readings = lambda c: [(c, 0.0)] if c.isalpha() else [(x, X.SIGN) for x in X.READINGS[c]]
    for token in ("1o1", "ab1", "6a1", "1"):
        best = max((sum(p for _, p in path) + sum(model[a][b] for a, b in zip([0, *codes], [*codes, 0], strict=True)), "".join(x for x, _ in path)) for path in product(*map(readings, token)) for codes in [[ord(x) - 96 for x, _ in path]])
        got = X.decode(token, model)
        if len(got) == len(token):
            assert got == best[1]


def test_character_model_is_a_distribution(model):
    assert all(math.isclose(sum(10**p for p in row), 1, rel_tol=1e-9) for row in model)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = X.op3_toxicity(spark, sf).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in out) / len(out) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def _planted(spark):
    clean = [(i, f"You are at a meeting and an agenda number{i} was kept by all of the members.", 0) for i in range(200)]
    bad = [(10_000 + i, f"You are an {('idiot', 'agenda')[i % 2]} and a {('meeting', 'moron')[i % 2]} number{i} was kept by all of the members.", 1) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in clean + bad], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in clean + bad], "doc_id long, toxic int")


def test_obfuscated_texts_are_caught(spark):
    docs, labels = _planted(spark)
    new = [(500, "what an 1d10t he is", True), (501, "such a m.o.r.o.n there", True), (502, "he is an i d i o t now", True), (503, "an idiiiioooot", True), (504, "a mor on", True), (505, "you are at an agenda", False), (506, None, False), (507, "", False), (508, "agenda " * 100_000, False), (None, "you IDIOT!", True)]
    extra = spark.createDataFrame([(i, t) for i, t, _ in new], "doc_id long, text string")
    scored = {r.text: r["__toxic"] for r in X.score(docs.unionByName(extra), labels, F.lit(True)).collect()}
    for _, t, bad in new:
        assert (scored[t] >= 0.5) == bad, t


def test_words_in_pieces_and_with_hidden_letters(spark):
    """Gaps anywhere in a word, gaps between signs, one or two hidden letters; the same pieces apart from each other say nothing."""
    docs, labels = _planted(spark)
    bad = ["id iot", "i d i o t", "id i ot", "i di ot", "id io t", "mo ro n", "m oro n", "1d 10 t", "1d i 0t", "mo r0 n", "i*iot", "m*ron", "m#r*n", "id10t", "i*10t"]
    clean = ["id was i here ot", "mo said ro n", "i dine", "id: 10 to 20", "more on it", "50% of m*n", "10 20 30 40", "i d", "mo ro"]
    rows = [(1000 + i, f"what an {w} he is") for i, w in enumerate(bad)] + [(2000 + i, f"what an {w} he is") for i, w in enumerate(clean)]
    scored = {r.doc_id: r["__toxic"] for r in X.score(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")), labels, F.lit(True)).collect()}
    assert [t for d, t in rows if (scored[d] >= 0.5) != (d < 2000)] == []


def test_words_beyond_the_list_count_by_their_bucket(spark, monkeypatch):
    docs, labels = _planted(spark)
    monkeypatch.setattr(X, "LISTED", 1)
    made = X.fit(docs, labels, X.character_model(docs), F.lit(True))
    assert len(made.listed) == 1
    other = ({"idiot", "moron"} - set(made.listed)).pop()
    assert made.weight(other) == X.STRONG


def test_edge_cases(spark):
    docs, labels = _planted(spark)
    docs = docs.withColumn("score", F.lit("kept"))
    kept = X.keep_clean(docs, labels)
    assert kept.columns == docs.columns and all(r.doc_id < 1000 for r in kept.collect()) and kept.count() == 200
    assert X.score(docs.limit(0), labels, F.lit(True)).count() == 0
    assert len({r["__toxic"] for r in X.score(docs, labels.limit(0), in_fold(F.col("doc_id"), 9)).collect()}) == 1
    odd = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (3, 0)], "doc_id long, toxic int"))
    assert X.keep_clean(docs, odd).count() == 200
    restored = {r.doc_id: r.text for r in X.restore_texts(spark.createDataFrame([(901, "an 1d10t here"), (902, None)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))).collect()}
    assert restored[901] == "an idiot here" and restored[902] is None


def test_two_letter_words_are_caught(spark):
    """A listed word of two letters after squeezing counts, in plain, repeated and other forms."""
    clean = [(i, f"You read it at a meeting number{i} with all of the members.", 0) for i in range(200)]
    bad = [(1_000 + i, f"You are an ass number{i} with all of the members.", 1) for i in range(60)]
    rows = spark.createDataFrame(clean + bad, "doc_id long, text string, toxic int")
    new = [(5_000, "such an ass there"), (5_001, "such an aasss there"), (5_002, "such an AS there"), (5_003, "such a meeting there")]
    docs = rows.select("doc_id", "text").unionByName(spark.createDataFrame(new, "doc_id long, text string"))
    scored = {r.doc_id: r["__toxic"] >= 0.5 for r in X.score(docs, rows.select("doc_id", "toxic"), F.lit(True)).collect()}
    assert [scored[d] for d, _ in new] == [True, True, True, False] and all(scored[d] for d, _, _ in bad)


def test_long_runs_and_words_of_signs_are_caught(spark):
    """A whole sentence spaced out, and listed words without a letter of their own; numbers are no words."""
    clean = [(i, f"You are at a loose toll of oil and a meeting was kept by all {i} of the members.", 0) for i in range(200)]
    bad = [(1_000 + i, f"You are a {('loss', 'toll')[i % 2]} and {('meeting', 'idiot')[i % 2]} was kept by all {i} of the members.", 1) for i in range(60)]
    rows = spark.createDataFrame(clean + bad, "doc_id long, text string, toxic int")
    spaced = " ".join("youareanidiotandallofthemembersareatameeting").replace("i d i o t", "1 d 1 0 t")
    assert len(spaced.split()) < 48
    long = " ".join("allofthemembersofthemeetingwerekeptatameetingandyouarean") + " 1 d 1 0 t"
    new = [(5_000, long), (5_001, spaced), (5_002, "he is a 1055 now"), (5_003, "he is a 1 0 5 5 now"), (5_004, "on 3.14 of 1,000 or 2024"), (5_005, "7" * 100_000)]
    docs = rows.select("doc_id", "text").unionByName(spark.createDataFrame(new, "doc_id long, text string"))
    scored = {r.doc_id: r["__toxic"] >= 0.5 for r in X.score(docs, rows.select("doc_id", "toxic"), F.lit(True)).collect()}
    assert [scored[d] for d, _ in new] == [True, True, True, True, False, False]


def test_decode_is_linear(model):
    assert len(X.decode("ab1" * 100_000, model)) >= 200_000


def brute_scores(docs, marks):
    """Scores of {id: text} by plain loops, learning from {id: mark}; only decoding is the operator's own."""
    pairs = Counter()
    code = lambda b: b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0
    for t in docs.values():
        s = [0, *map(code, t.encode()), 0]
        pairs.update(zip(s, s[1:]))
    model = [[math.log10((pairs[a, b] + 0.5) / sum(pairs[a, c] + 0.5 for c in range(28))) for b in range(28)] for a in range(28)]
    tokens = lambda t: [x.decode() for x in t.encode().lower().split()]

    def word_set(t):
        ts, out, i = tokens(t), set(), 0
        while i < len(ts):
            j = i
            while j < len(ts) and len(ts[j]) == 1:
                j += 1
            if j - i >= 3:
                out.add(X.squeeze(X.restore("".join(ts[i:j]), model)))
            i = max(j, i + 1)
        return (out | {X.restored(w, model) for w in ts}) - {""}

    taught = {}
    for d, m in marks.items():
        taught[docs[d]] = max(m, taught.get(docs[d], 0))
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    texts = [(word_set(t), m, signed(t) % X.FOLDS) for t, m in taught.items()]
    bad, n = sum(m for _, m, _ in texts), len(texts)
    share = (bad + 1) / (n + 10)

    def odds(w, but=None):
        seen = [m for ws, m, f in texts if w in ws and f != but]
        return math.log((sum(seen) + X.PRIOR * share) / (len(seen) - sum(seen) + X.PRIOR * (1 - share))) - math.log(share / (1 - share))

    cache = {}
    held = lambda w, f: cache[w, f] if (w, f) in cache else cache.setdefault((w, f), odds(w, f))
    x = np.array([[math.log1p(sum(max(held(w, f) - X.STRONG, 0) for w in ws)), sum(held(w, f) for w in ws) / (len(ws) + X.SHORT)] for ws, _, f in texts])
    slopes, level = X.rising(x, np.array([m for _, m, _ in texts], float))
    every = {w: odds(w) for w in {w for ws, _, _ in texts for w in ws}}
    listed = {w: v for w, v in every.items() if v > X.STRONG}
    shared = {}
    for w in every.keys() - listed.keys():
        shared.setdefault(zlib.crc32(w.encode()) % X.BUCKETS, []).append(w)
    table = {}
    for bucket, ws in shared.items():
        seen = [(sum(m for s, m, _ in texts if w in s), sum(1 - m for s, m, _ in texts if w in s)) for w in ws] if len(ws) > 1 else None
        table[bucket] = every[ws[0]] if seen is None else min(X.STRONG, math.log((sum(b for b, _ in seen) + X.PRIOR * share) / (sum(g for _, g in seen) + X.PRIOR * (1 - share))) - math.log(share / (1 - share)))

    def score(t):
        ts = tokens(t)
        meant = lambda w: s if (s := X.signs_read(w, model)) in listed else X.restored(w, model)
        words = [meant(w) for w in ts]
        found = set(words) - {""}
        i = 0
        while i < len(ts):
            j = i
            while j < len(ts) and len(ts[j]) == 1 and words[j] not in listed:
                j += 1
            if j - i >= 3:
                said, at = X.squeeze(X.restore("".join(ts[i:j]), model)), 0
                while at < len(said):
                    k = max((len(w) for w in listed if said.startswith(w, at)), default=0)
                    found |= {said[at : at + k]} if k else set()
                    at += k or 1
                found |= {X.signs_read("".join(ts[i:j]), model)} & listed.keys()
            i = max(j, i + 1)
        for i in range(len(ts) - 1):
            opens = words[i] not in listed and (len(ts[i]) == 1 or any(w.startswith(words[i]) for w in listed if words[i]))
            if opens and words[i + 1] not in listed:
                found |= {meant(ts[i] + ts[i + 1])} & listed.keys()
        weights = [listed[w] if w in listed else table.get(zlib.crc32(w.encode()) % X.BUCKETS, 0.0) for w in found]
        z = slopes[0] * math.log1p(sum(max(w - X.STRONG, 0) for w in weights)) + slopes[1] * sum(weights) / (len(weights) + X.SHORT) + level
        return 1 / (1 + math.exp(-z))

    return {d: score(t) for d, t in docs.items()}


def test_scores_by_brute_force(spark, sf_dir):
    """The whole query, and planted words in all forms."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic is not None and r.doc_id in docs}
    want = brute_scores(docs, {d: m for d, m in marks.items() if zlib.crc32(str(d).encode()) % 5})
    got = {r.doc_id: r.score for r in X.op3_toxicity(spark, sf_dir).collect()}
    assert got == pytest.approx(want, rel=1e-6)
    planted, labels = _planted(spark)
    new = [(500, "what an 1d10t he is"), (501, "m.o.r.o.n there"), (502, "he is an i d i o t now"), (503, "i d 1 o t m o r o n"), (504, "a mor on"), (505, "a i d"), (506, ""), (507, "agenda " * 50)]
    planted = planted.unionByName(spark.createDataFrame(new, "doc_id long, text string"))
    want = brute_scores({r.doc_id: r.text for r in planted.collect()}, {r.doc_id: r.toxic for r in labels.collect()})
    assert {r.doc_id: r["__toxic"] for r in X.score(planted, labels, F.lit(True)).collect()} == pytest.approx(want, rel=1e-6)


def test_scores_are_graded_and_better_than_a_list(spark):
    """Held-out ranking at sf0.1, and more than a handful of scores."""
    sf = "/root/testdata/sf0.1"
    rows = X.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("held_out", "score", "predicted", "toxic").collect()
    out = [(r.score, r.toxic, r.predicted) for r in rows if r.held_out]
    bad, good = [s for s, y, _ in out if y], [s for s, y, _ in out if not y]
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good) > 0.97
    assert sum(p for _, y, p in out if y) / len(bad) > 0.9 and sum(p for _, y, p in out if not y) / len(good) < 0.02
    assert len({round(r.score, 9) for r in rows}) > 1000


def test_clashing_name(spark):
    docs, labels = _planted(spark)
    docs = docs.withColumn("__toxic", F.lit(0.25))
    kept = X.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r["__toxic"] for r in kept.collect()} == {0.25}


def test_reading_without_signs_needs_no_decoding(model):
    for token in ["it's", "i.d.i.o.t", "id--iot,", "a;b?c", "mo ron".replace(" ", "\u00e9-"), "aa-aab", "x_", "3.14", "...", "", "\u00a3", "a\u20acb", "l0ser!!", "id*ot", "a'b\u00fcrr", "--q--"]:
        assert X.restored(token, model) == X.squeeze(X.restore(token, model)), token

"""Decontamination against brute force."""

from __future__ import annotations

import hashlib
import re

from provisio.llm import decontaminate as X


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        b = words(t)
        n = min(10, len(b))
        grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for s in range(len(w) - n + 1):
            if n and tuple(w[s : s + n]) in grams:
                hit.update(range(s, s + n))
                if i is not None:
                    ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def _rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert _rows(X.op8_decontaminate(spark, sf_dir)) == sorted(((d, *brute(t, items)) for d, t in docs), key=str)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short Item"), (3, "solo"), (4, None), (5, "--"), (None, "nameless thing here"), (10, "two three four five six seven eight nine ten eleven twelve"), (2, "Short Item")]
DOCS = [(1, None, 1), (2, "", 2), (3, "ONE two three four five six seven eight nine ten eleven twelve! short ITEM", 3), (3, "ONE two three four five six seven eight nine ten eleven twelve! short ITEM", 3), (4, "a nameless thing here", 4), (None, "solo é short item solo", 5), (5, "pad " * 60_000 + "short item", 6), (6, "clean text", 7)]


def test_edge_cases(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string, items int"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(((d, *brute(t, ITEMS)) for d, t, _ in DOCS), key=str)
    assert _rows(X.contamination(docs, items)) == want
    assert _rows(X.contamination(docs, items, max_broadcast=0)) == want
    assert X.contamination(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in X.contamination(docs, items.limit(0)).collect())
    kept = X.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.items for r in kept.collect()) == [1, 2, 7]
    cut = {r.items: r.text for r in X.remove_spans(docs, items).collect()}
    assert cut[5] == "é" and cut[7] == "clean text" and cut[4] == "a" and cut[1] is None


def test_clashing_names(spark):
    words = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, words, 1, 2, 3), (2, "clean text", 1, 2, 3)], "doc_id long, text string, __id int, __hash int, __cuts int")
    items = spark.createDataFrame([("q", words)], "item_id string, text string")
    kept = X.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    cut = X.remove_spans(docs, items)
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()} == {1: "", 2: "clean text"}


def test_bitmap_keeps_every_beginning_and_few_others(spark):
    """The bitmap before the shuffle lets all windows' beginnings through, and hardly any other position."""
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(i, " ".join(f"t{i}x{k}" for k in range(11))) for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"own{i}x{k}" for k in range(30)) + " " + " ".join(f"t{i}x{k}" for k in range(11))) for i in range(300)], "doc_id long, text string")
    words = docs.select("doc_id", F.split("text", " ").alias("words"), F.lit(10).alias("at_length")).select("*", F.posexplode("words").alias("start", "word")).filter("start + 10 <= size(words)")
    kept = X.maybe_begins(words, X.test_windows(items)).groupBy("start").count().collect()
    at = {r.start: r["count"] for r in kept}
    assert at[30] == at[31] == 300 and sum(at.values()) < 610


def test_words_are_cut_once(spark):
    """One pass over the texts for the windows, one for n_words: the words of a text are cut once in each, also with several lengths."""
    docs, many = spark.createDataFrame(DOCS, "doc_id long, text string, items int"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for items in (many, many.filter("item_id IN (1, 10)")):
        for max_broadcast in (X.MAX_BROADCAST, 0):
            plan = X.hits(docs, items, max_broadcast=max_broadcast)._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("regexp_extract_all") == 1


def test_words_at_every_code_point(spark):
    from pyspark.sql import functions as F

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [(k, "".join(f"Qx{chr(c)}" for c in points[k : k + 4096])) for k in range(0, len(points), 4096)]
    rows = spark.createDataFrame(texts, "k long, text string").select("k", X._words(F.col("text")).alias("w"), F.regexp_count("text", F.lit(X.ANY_CASE_WORD)).alias("n")).collect()
    want = {k: words(t) for k, t in texts}
    assert {r.k: r.w for r in rows} == want and {r.k: r.n for r in rows} == {k: len(w) for k, w in want.items()}

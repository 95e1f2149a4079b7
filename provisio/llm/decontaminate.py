"""Benchmark decontamination: scan the token windows of training texts against a broadcast set of test n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, only, spool, table, unused, whole_text

WINDOW = 10
#: The set of test windows is broadcast up to this many rows (about 200 bytes each); a larger set is joined by shuffle.
MAX_BROADCAST = 1_000_000
#: Bits of the bitmap that keeps most positions out of that shuffle: 16 MB.
BITS = 2**27
#: Words of a window that are looked up first.
HEAD = 3
#: What [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ matches, told by what is in the class: Java takes a quarter of the time for it.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
ANY_CASE_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(whole_text(text)), F.lit(WORD), F.lit(0))


def _head(length: Column, *words: Column) -> Column:
    """Hash of the first HEAD words of a window, or of all of a shorter one."""
    hashed = F.xxhash64(*words)
    for n in range(HEAD - 1, 0, -1):
        hashed = F.when(length == n, F.xxhash64(*words[:n])).otherwise(hashed)
    return hashed


def test_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Every distinct window of the items: its length, words, hash and the list of its items.

    An item with fewer words than the window is one window; an item without words has none. A null item id leaves its
    windows in force but names no item.
    """
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), _words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = words.select("item", "words", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("start"))
    windows = starts.select("item", F.slice("words", F.col("start"), F.col("length")).alias("gram"))
    return windows.groupBy("gram").agg(F.array_compact(F.collect_set("item")).alias("items")).select("gram", "items", F.size("gram").alias("length"), F.xxhash64("gram").alias("hash"))


def maybe_begins(at: DataFrame, windows: DataFrame) -> DataFrame:
    """The positions (start, words, at_length, word) whose first words have the hash, modulo BITS, of a window's first words.

    The bits are a broadcast table of BITS / 8 bytes, whatever the number of windows; a position too many does no harm.
    """
    heads = windows.select(F.pmod(_head(F.col("length"), *(F.get("gram", F.lit(i)) for i in range(HEAD))), F.lit(BITS)).alias("bit"))
    bitmaps = heads.groupBy(F.bitmap_bucket_number("bit").alias("map_number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    bit = F.pmod(_head(F.col("at_length"), F.col("word"), *(F.get("words", F.col("start") + i) for i in range(1, HEAD))), F.lit(BITS))
    told = at.withColumn("at_bit", bit)
    met = told.join(F.broadcast(bitmaps), F.bitmap_bucket_number("at_bit") == F.col("map_number"))
    place = F.bitmap_bit_position("at_bit").cast("int")
    byte = F.conv(F.hex(F.substring("map", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.filter((F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1)).drop("at_bit", "map_number", "map")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each occurrence of a test window in a text: doc_id, text_hash, start (word, from 0), length, items."""
    windows = spool(test_windows(benchmark, window), "windows")
    found = windows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `window` rows
    if not found:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("items")).filter("false")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), _words(F.col(text_col)).alias("words"))
    lengths = F.array(*(F.lit(r["length"]) for r in sorted(found)))
    # Positions come last, so that no row with a whole text is copied for each of its words. The outer form keeps Spark from
    # cutting the words twice: for the inner one it first filters texts by whether they have any. The null start drops out.
    at = texts.withColumn("at_length", F.explode(lengths)) if len(found) > 1 else texts.withColumn("at_length", F.lit(found[0]["length"]))
    at = at.select("*", F.posexplode_outer("words").alias("start", "word")).filter(F.col("start") + F.col("at_length") <= F.size("words"))
    gram = F.slice("words", F.col("start") + 1, F.col("at_length"))
    if sum(r["n"] for r in found) <= max_broadcast:
        # Few positions begin with the first words of a test window; only those build and hash the whole window.
        heads = windows.select(_head(F.col("length"), *(F.get("gram", F.lit(i)) for i in range(HEAD))).alias("head")).distinct()
        at = at.join(F.broadcast(heads), _head(F.col("at_length"), F.col("word"), *(F.get("words", F.col("start") + i) for i in range(1, HEAD))) == F.col("head"), "left_semi")
        matched = at.join(F.broadcast(windows.drop("items")), (F.xxhash64(gram) == F.col("hash")) & (gram == F.col("gram")))
    else:
        # Too many windows to broadcast: the windows of the texts are shuffled, each with its own words alone, and of them
        # only those whose first words have their bit in a bitmap of a fixed size.
        at = maybe_begins(at, windows)
        at = at.select("doc_id", "text_hash", "start", gram.alias("at_gram")).withColumn("at_hash", F.xxhash64("at_gram"))
        matched = at.join(windows.drop("items"), (F.col("at_hash") == F.col("hash")) & (F.col("at_gram") == F.col("gram")))
    # The list of a window's items has no bound, so it is not broadcast with the window but joined to the hits.
    matched = matched.select("doc_id", "text_hash", "start", "length", F.col("hash").alias("hit_hash"), F.col("gram").alias("hit_gram"))
    listed = windows.select("hash", "gram", "items")
    return matched.join(listed, (F.col("hit_hash") == F.col("hash")) & (F.col("hit_gram") == F.col("gram"))).select("doc_id", "text_hash", "start", "length", "items")


def spans(found: DataFrame) -> DataFrame:
    """The hit words of each text as disjoint spans: doc_id, text_hash, start, stop (words, from 0, stop excluded)."""
    text = W.partitionBy("doc_id", "text_hash").orderBy("start", "length")
    reach = F.max(F.col("start") + F.col("length")).over(text.rowsBetween(W.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(F.col("start") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("new").over(text.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("stop")).drop("run")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of a test window; n_items counts the items with such windows, and
    items_sha256 is the digest of their ids, sorted as strings and comma-joined (that of the empty string for none).
    Null, empty and wordless texts have no words and no hits. Repeated rows each get their row; an empty benchmark
    or empty docs give no hits or no rows. Ids may be null or repeat: hits are kept by id and hash of the text.
    """
    found = spool(hits(docs, benchmark, window, max_broadcast, id_col, text_col), "hits")
    covered = spans(found).groupBy("doc_id", "text_hash").agg(F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_hit"))
    items = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    dirty = covered.join(items, same(covered, items)).select(covered["doc_id"], covered["text_hash"], "n_hit", "items")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.regexp_count(whole_text(F.col(text_col)), F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"))
    joined = rows.join(dirty, same(rows, dirty), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return joined.select(
        rows["doc_id"], rows["text_hash"], "n_words", n_hit.alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a test window; its columns unchanged.

    Rows without words stay; repeated rows go or stay together; a null id is told apart from others by its text.
    """
    id_, hash_ = unused(docs, "__id"), unused(docs, "__hash")
    found = hits(docs, benchmark, window, max_broadcast, id_col, text_col).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(hash_)), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the hit words cut out of the text; what stays is normalised to lower-case words and single spaces.

    Rows without hits keep their text as it is.
    """
    id_, hash_, cut = unused(docs, "__id"), unused(docs, "__hash"), unused(docs, "__cuts")
    runs = spans(hits(docs, benchmark, window, max_broadcast, id_col, text_col))
    cuts = runs.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.collect_list(F.struct("start", "stop")).alias(cut))
    kept = F.filter(_words(F.col(text_col)), lambda w, i: ~F.exists(cut, lambda c: (i >= c["start"]) & (i < c["stop"])))
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.array_join(kept, " "))
    joined = docs.join(cuts, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(hash_)), "left")
    return only(joined.withColumn(text_col, text), docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item, w[s:s + least(len(w), 10) - 1] AS gram FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(gram) AS n FROM bg),
dg AS (SELECT row_id, s, n, w[s:s + n - 1] AS gram FROM (SELECT row_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT row_id, s, n, item FROM dg JOIN bg USING (gram)),
words AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY row_id),
items AS (SELECT row_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (row_id) LEFT JOIN items USING (row_id)
"""

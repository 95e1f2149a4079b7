"""Substring deduplication: hash normalised units, keep the earliest ranked occurrence, cut the others out.

Units are the sentences of every line (or whole lines, or paragraphs); one of more than PIECE words is cut again by
winnowing: after the word of least hash in each window of PIECE words. No piece is longer, and a passage loses at most
PIECE words at each edge, wherever it stands. Digests are grouped over all documents; those that occur again meet their units a
second time and learn their earliest place. Repeated units of a document form a span with those whose earliest places lie
in the same document at the same distance, if all between them agrees, too. A span of enough words is removed: it stands as
a whole at one earlier place. Digests that occur once are kept out by a bitmap of fixed size. Offsets are code points of the original text.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import only, spool, table, unused, whole_text

#: Words that a span of repeated units needs to be removed: what counts as a repeated passage. With 1, and lines as units,
#: every line that occurs before is removed, however short.
LEAST_WORDS = 20
#: Words of a piece, at most, and of the windows that choose where units are cut. A repeated passage of n words keeps
#: n - 2 * PIECE words or more in repeated pieces: 31 of 51.
PIECE = 10
#: Words of the units that are looked up; shorter ones go with those on either side, and stay where they end a passage.
ANCHOR = 4
#: Bits of the bitmap that tells repeated digests: 16 MB.
BITS = 2**27
#: Modulus of the sums that tell whether two documents agree between two places.
LINK = 2**60
#: Where units end.
ENDS = {"sentence": re.compile(r"(?<=[.!?])[ \t]+|\n+"), "line": re.compile(r"\n+"), "paragraph": re.compile(r"\n\s*\n")}
_WORD = re.compile(r"\S+")


def cuts(hashes: list[int], window: int = PIECE) -> list[int]:
    """Places of the least hash, the last of equal ones, in each window of so many hashes."""
    found: list[int] = []
    least = -1
    for i in range(window - 1, len(hashes)):
        if least > i - window:
            if hashes[i] > hashes[least]:
                continue
            least = i
        else:
            part = hashes[i : i - window : -1] if i >= window else hashes[i::-1]
            least = i - part.index(min(part))
        found.append(least)
    return found


def pieces(words: list[str]) -> list[int]:
    """Where the pieces of a unit of these words end."""
    if len(words) <= PIECE:
        return [len(words)] if words else []
    found = [last + 1 for last in cuts([zlib.crc32(w.encode()) for w in words])]
    return found if found[-1] == len(words) else [*found, len(words)]


def cut_words(text: str, ends: re.Pattern) -> Iterator[list[str]]:
    """The words of each unit, lower-cased, long ones cut into pieces."""
    for unit in ends.split(text):
        words = unit.lower().split()
        first = 0
        for end in pieces(words):
            yield words[first:end]
            first = end


def _digest(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words)) - 2**63


def repeated_bits(docs: DataFrame, unit: str = "sentence", anchor: int = ANCHOR, text_col: str = "text") -> bytes:
    """A bitmap of BITS bits: those of the digests of anchors (units of so many words) that occur more than once in docs, modulo BITS.

    Digests are counted by a shuffle; only the bitmap, whose size is fixed, reaches the driver. The more digests repeat, the more
    others share their bits; that costs work, but no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = ENDS[unit]
        for batch in batches:
            digests = array("q")
            for text in batch.column(0):
                digests.extend(_digest(w) for w in cut_words(text.as_py(), ends) if len(w) >= anchor)
                if len(digests) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(digests, np.int64))], ["digest"])
                    digests = array("q")
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(digests, np.int64), pa.int64())], ["digest"])

    found = docs.select(whole_text(F.col(text_col)).alias("text")).mapInArrow(run, "digest long")
    bit = F.pmod("digest", F.lit(BITS)) + 1  # these functions count from 1
    maps = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy(F.bitmap_bucket_number(bit).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("map"))
    bits = bytearray(BITS // 8)
    for row in maps.toLocalIterator():  # BITS / 32,768 rows of 4 KB
        bits[(row.number - 1) * 4096 : row.number * 4096] = row.map
    return bytes(bits)


def units(docs: DataFrame, unit: str = "sentence", anchor: int = 1, bits: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, ord, start, stop, begin, words, nth, prior, linked, digest (64 bits) for each unit of `anchor` words or more.

    ord counts all units; begin counts the words of the text before the unit, nth the equal units right before it; linked sums, modulo
    LINK, the hashes of all neighbouring pairs of units up to this one, prior those up to the one before (0 where nth is 0).
    bits: of repeated_bits(); units without their bit are left out, and their offsets aren't looked for.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, bits, pair = ENDS[unit], shared.value, xxhash.xxh3_64_intdigest
        pack = struct.Struct("<qq").pack
        for batch in batches:
            row, ints, longs = array("q"), array("i"), array("q")

            def out() -> pa.RecordBatch:
                rows = pa.array(np.frombuffer(row, np.int64), pa.int64())
                columns = [*np.frombuffer(ints, np.int32).reshape(-1, 6).T, *np.frombuffer(longs, np.int64).reshape(-1, 3).T]
                return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, columns)], ["doc_id", "text_hash", "ord", "start", "stop", "begin", "words", "nth", "prior", "linked", "digest"])

            for i, text in enumerate(batch.column(2)):
                text, at, k, begin, total, last, nth = text.as_py(), 0, 0, 0, 0, 0, 0
                for stop, after in [*((m.start(), m.end()) for m in ends.finditer(text)), (len(text), len(text))]:
                    words = text[at:stop].lower().split()
                    spans, first = None, 0
                    for end in pieces(words):
                        digest = _digest(words[first:end])
                        prior, nth = (total, nth + 1) if k and digest == last else (0, 0)
                        total = (total + pair(pack(last, digest))) % LINK
                        if end - first >= anchor and (bits is None or bits[digest % BITS >> 3] >> (digest & 7) & 1):
                            if len(words) <= PIECE:
                                a, b = at, stop
                            else:
                                spans = spans or [m.span() for m in _WORD.finditer(text, at, stop)]
                                a, b = spans[first][0], spans[end - 1][1] if end < len(words) else stop
                            row.append(i)
                            ints.extend((k, a, b, begin + first, end - first, nth))
                            longs.extend((prior, total, digest))
                        first, last, k = end, digest, k + 1
                    begin, at = begin + len(words), after
                if len(row) >= 100_000:
                    yield out()
                    row, ints, longs = array("q"), array("i"), array("q")
            yield out()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), whole_text(F.col(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, ord int, start int, stop int, begin int, words int, nth int, prior long, linked long, digest long")


def repeated_spans(docs: DataFrame, unit: str = "sentence", least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", anchor: int = ANCHOR) -> DataFrame:
    """doc_id, text_hash, start, stop, words, first_id for each span to remove.

    A unit of `anchor` words or more (least_words, if that is less) stays at its earliest place by (doc_id, hash of the text, place in the text), a null id last, and is
    repeated everywhere else, in the same document too. Repeated units of a document whose earliest places lie in one
    document at one distance belong together as far as all units between them, too, are the same in both
    documents: the sums of the units' linked hashes tell. So a span stands as a whole in the document first_id. A unit
    that follows its like has its earliest place as the nth of equal neighbours, and besides repeats the one before it. Spans of PIECE words or more
    (least_words, if that is less) are removed where they, with such neighbours no more than PIECE words away, have least_words words; of spans that
    overlap, the later one keeps what is left of it. Rows that agree in id and text are one document. Null and blank
    texts have no units.
    """
    document = ["doc_id", "text_hash"]
    anchor = min(anchor, least_words)
    cut = spool(units(docs, unit, anchor, repeated_bits(docs, unit, anchor, text_col), id_col, text_col), "repeated", "zstd")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("ord").alias("ord"), F.col("linked").alias("linked"))
    firsts = spool(cut.groupBy(F.col("digest").alias("d"), F.col("nth").alias("n")).agg(F.min(place).alias("first")), "firsts")
    later = cut.join(firsts, (F.col("digest") == F.col("d")) & (F.col("nth") == F.col("n"))).filter(place > F.col("first"))
    where = [*document, "ord", "start", "stop", "begin", "words", "linked"]
    origin = later.select(*where, F.col("first.id").alias("first_id"), F.col("first.hash").alias("first_hash"), (F.col("ord") - F.col("first.ord")).alias("shift"), F.col("first.linked").alias("first_linked"))
    echoes = cut.filter("nth > 0").select(*where, F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"), F.lit(1).alias("shift"), F.col("prior").alias("first_linked"))
    origin = origin.unionByName(echoes)
    piece = [*document, "first_id", "first_hash", "shift"]
    in_order = W.partitionBy(*piece).orderBy("ord")
    gap = lambda c: F.pmod(F.col(c) - F.lag(c).over(in_order), F.lit(LINK))
    joined = F.coalesce(gap("linked") == gap("first_linked"), F.lit(False))
    runs = origin.withColumn("new", (~joined).cast("int")).withColumn("run", F.sum("new").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy(*piece, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("begin").alias("begin"), F.max(F.col("begin") + F.col("words")).alias("end")).filter(F.col("end") - F.col("begin") >= min(PIECE, least_words))
    before = W.partitionBy(*document).orderBy("start", F.desc("stop"), "first_id", "first_hash", "shift").rowsBetween(W.unboundedPreceding, -1)
    cleared = spans.withColumns({"done": F.coalesce(F.max("stop").over(before), F.lit(0)), "done_words": F.coalesce(F.max("end").over(before), F.lit(0))}).filter(F.col("stop") > F.col("done"))
    cleared = cleared.select(*document, F.greatest("start", "done").alias("start"), "stop", F.greatest("begin", "done_words").alias("begin"), "end", "first_id")
    text = W.partitionBy(*document).orderBy("begin")
    apart = F.coalesce(F.col("begin") - F.lag("end").over(text) > PIECE, F.lit(False)).cast("int")
    chains = cleared.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(text.rowsBetween(W.unboundedPreceding, 0)))
    total = F.sum(F.col("end") - F.col("begin")).over(W.partitionBy(*document, "chain"))
    return chains.withColumn("total", total).filter(F.col("total") >= least_words).select(*document, "start", "stop", (F.col("end") - F.col("begin")).alias("words"), "first_id")


def removals(docs: DataFrame, unit: str = "sentence", least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, removed_words, spans (start, stop, first_id) for each row of docs; no spans: an empty array."""
    found = repeated_spans(docs, unit, least_words, id_col, text_col)
    listed = found.groupBy("doc_id", "text_hash").agg(F.sum("words").alias("removed_words"), F.array_sort(F.collect_list(F.struct("start", "stop", "first_id"))).alias("spans"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    listed = listed.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "removed_words", "spans")
    joined = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    none = F.array().cast(listed.schema["spans"].dataType)
    return joined.select("doc_id", "text_hash", F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), F.coalesce("spans", none).alias("spans"))


def deduplicate(docs: DataFrame, unit: str = "sentence", least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the repeated spans in their texts; its columns unchanged, null texts stay null."""

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, parts):
            if text is None or parts is None:
                return text
            kept, at = [], 0
            for p in parts:
                kept.append(text[at : p["start"]])
                at = p["stop"]
            return "".join([*kept, text[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    id_, hash_, parts = unused(docs, "__id"), unused(docs, "__hash"), unused(docs, "__spans")
    found = removals(docs, unit, least_words, id_col, text_col).filter(F.size("spans") > 0).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("spans").alias(parts)).dropDuplicates([id_, hash_])
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(hash_)), "left")
    return only(joined.withColumn(text_col, F.pandas_udf(cut, "string")(F.col(text_col), F.col(parts))), docs.columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans to remove from all documents."""
    found = removals(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "removed_words", F.size("spans").alias("n_spans"), "spans")

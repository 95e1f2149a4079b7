"""Splitting texts into addressable fragments, and token budgets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# The limits of the cost classes (sources, calls, tokens) and of the context window.
COST_CLASSES = [("very_large", 18, 48, 180_000), ("large", 12, 24, 120_000), ("medium", 6, 12, 80_000)]
CONTEXT_TOKENS, PROMPT_TOKENS = 200_000, 150_000


def hard_split(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of `size` characters, `overlap` of them shared with the window before: adds part (from 0), piece."""
    step = max(256, size - max(0, overlap)) if size > max(0, overlap) else size
    body = F.trim(text)
    starts = F.when(F.length(body) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(body) - 1, F.lit(step)))
    cut = df.filter(body != "").withColumn("__start", F.explode(starts))
    return cut.withColumns({"part": (F.col("__start") / step).cast("int"), "piece": F.substr(body, F.col("__start") + 1, F.lit(size))}).drop("__start")


def heading_split(df: DataFrame, text: str, locator: str, kind: str = "Article") -> DataFrame:
    """One row for each `Article N` (or `Section N`) line with what follows it; texts with fewer than two stay whole.

    Adds part (from 0), fragment_locator (base|heading), fragment_text.
    """
    body = F.trim(text)
    heading = rf"(?im)^(?={kind}\s+\d+[a-z]?\b)"
    parts = F.filter(F.split(body, heading), lambda p: p.rlike(rf"(?i)^{kind}\s+\d+"))
    cut = df.withColumn("__parts", F.when(F.size(parts) >= 2, parts).otherwise(F.array(body))).select("*", F.posexplode("__parts").alias("part", "__piece"))
    name = F.left(F.trim(F.regexp_extract("__piece", r"^([^\n]*)", 1)), F.lit(96))
    base = F.when(T.is_placeholder(F.col(locator)), name).otherwise(F.col(locator))
    place = F.when(F.size("__parts") >= 2, F.concat(base, F.lit("|"), F.regexp_replace(name, r"\s+", "_"))).otherwise(F.col(locator))
    return cut.withColumns({"fragment_locator": place, "fragment_text": F.trim("__piece")}).drop("__parts", "__piece")


def cut_hard(text: str, size: int, overlap: int) -> list[str]:
    """Windows of `size` characters that share `overlap`, as hard_split() gives them."""
    step = max(256, size - overlap) if size > overlap else size
    return [text[at : at + size] for at in range(0, len(text), step)] if len(text) > size else [text]


def paragraph_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed greedily into chunks of `size` characters; the next chunk opens with the last `overlap` ones of the
    chunk before, in addition to its size if need be. A paragraph above the size stands alone, cut hard; the tail of
    what came before it then opens what follows it. Time is linear in the text."""
    chunks: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held:
            chunks.append("\n\n".join(held))
            tail = chunks[-1][-overlap:].strip() if 0 < overlap < len(chunks[-1]) else ""
            held[:] = [tail] if tail else []

    width = 0
    for para in filter(None, (p.strip() for p in text.replace("\r\n", "\n").split("\n\n"))):
        if len(para) > size:
            close()
            chunks += cut_hard(para, size, overlap)
        else:
            if held and width + 2 + len(para) > size:
                close()
            held.append(para)
        width = sum(map(len, held)) + 2 * len(held) - 2 if len(held) < 3 else width + 2 + len(para)
    close()
    return chunks


def _from_headings(text: Column, kind: str) -> Column:
    """What begins at each line of the kind and a number, in order; what stands before the first one is left out."""
    return F.filter(F.split(text, rf"(?im)^(?={kind}\s+\d)"), lambda p: p.rlike(rf"(?i)^{kind}\s+\d+"))


def plan_slices(df: DataFrame, id_col: str, text: str, locator: str, size: int, overlap: int = 0) -> DataFrame:
    """id, ord, locator, piece, strategy: each text cut at <article> tags, else at Article lines, else at Section lines.

    At least two cuts are needed, else the text is one piece at its own locator (document:full for a placeholder). What
    is longer than `size` (2,048 at least) is packed by paragraphs and gets |chunk:000 and so on. Null and blank texts give no rows.
    """
    size, overlap = max(2048, size), max(0, overlap)
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\r\n"))
    own = F.when(T.is_placeholder(F.col(locator)), "document:full").otherwise(F.trim(locator))
    tags = F.filter(F.split(body, r"(?i)(?=<[\w:-]*article\b[^>]*>)"), lambda p: F.trim(p) != "")
    number = lambda p: F.regexp_extract(F.left(p, F.lit(240)), r"(?i)(?:n|\bnum|\bnumber)\s*=\s*[\"'](\d+)[\"']", 1)
    piece = lambda p, loc, how: F.struct(loc.alias("loc"), F.btrim(p, F.lit(" \t\r\n")).alias("piece"), F.lit(how).alias("how"))
    xml = F.transform(tags, lambda p, i: piece(p, F.concat(F.lit("article:"), F.coalesce(F.nullif(number(p), F.lit("")), (i + 1).cast("string"))), "article_xml"))
    articles = F.transform(_from_headings(body, "Article"), lambda p: piece(p, F.concat(F.lit("article:"), F.regexp_extract(p, r"(?i)^Article\s+(\d+[a-z]?)", 1)), "article_plain"))
    sections = F.transform(_from_headings(body, "Section"), lambda p: piece(p, F.concat(F.lit("section:"), F.regexp_extract(p, r"(?i)^Section\s+(\d+[.:]?)", 1)), "section_plain"))
    cut = F.when(F.lower(body).contains("<article") & (F.size(xml) >= 2), xml).when(F.size(articles) >= 2, articles).when(F.size(sections) >= 2, sections).otherwise(F.array(piece(body, own, "monolith")))
    rows = df.filter(body != "").select(F.col(id_col).alias("id"), F.posexplode(cut).alias("part", "s")).select("id", "part", "s.*").filter("piece <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for i, part, loc, whole, how in frame.itertuples(index=False):
                sub = [whole] if len(whole) <= size else paragraph_chunks(whole, size, overlap)
                one = len(sub) == 1
                for k, c in enumerate(sub):
                    out.append((i, part, k, loc if one else f"{loc}|chunk:{k:03d}", c.strip(), how if len(whole) <= size else how + ("|bounded" if one else "|chunk")))
            yield pd.DataFrame(out, columns=["id", "part", "nth", "locator", "piece", "strategy"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, part int, nth int, locator string, piece string, strategy string")


def split_list_items(text: Column) -> Column:
    """The items of a text whose lines open with list marks, with what stands before them; the text itself without two."""
    body = F.btrim(text, F.lit(" \t\r\n"))
    items = F.filter(F.transform(F.split(body, r"(?im)^(?=(?:\(\w+\)|\[\w+\]|[a-z]\)|\d+\))\s+)"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    return F.when(body == "", F.array().cast("array<string>")).when(F.size(items) >= 2, items).otherwise(F.array(body))


def expand_fragments(fragments: DataFrame, size: int, overlap: int = 0, large: int = 8000) -> DataFrame:
    """fragments (id, source_record_id, locator, fragment_text) with the oversized ones replaced by their slices.

    A fragment is cut if its text is longer than `size`, or stands at a placeholder, has `large` characters and several
    articles or sections. Slices get ids frag-<source>-001 and so on, and parent_id names the fragment they come from;
    fragments that stay have a null parent_id and the strategy null.
    """
    body = F.btrim(F.coalesce("fragment_text", F.lit("")), F.lit(" \t\r\n"))
    many = (F.size(F.split(body, r"(?i)(?=<[\w:-]*article\b[^>]*>)")) >= 2) | (F.size(_from_headings(body, "Article")) >= 2) | (F.size(_from_headings(body, "Section")) >= 2)
    marked = fragments.select("id", "source_record_id", "locator", "fragment_text", ((F.length(body) > size) | (T.is_placeholder(F.col("locator")) & (F.length(body) >= large) & many)).alias("cut"))
    sliced = plan_slices(marked.filter("cut"), "id", "fragment_text", "locator", size, overlap).withColumnRenamed("id", "parent_id")
    nth = F.row_number().over(W.partitionBy("parent_id").orderBy("part", "nth")).cast("string")
    named = sliced.join(marked.select(F.col("id").alias("parent_id"), "source_record_id"), "parent_id")
    fid = F.concat(F.lit("frag-"), T.slug(F.col("source_record_id")), F.lit("-"), F.when(F.length(nth) < 3, F.lpad(nth, 3, "0")).otherwise(nth))
    stay = marked.filter("NOT cut").select("id", F.lit(None).cast(marked.schema["id"].dataType).alias("parent_id"), "source_record_id", "locator", "fragment_text", F.lit(None).cast("string").alias("strategy"))
    return stay.unionByName(named.select(fid.alias("id"), "parent_id", "source_record_id", "locator", F.col("piece").alias("fragment_text"), "strategy"))


def paragraph_overlap(df: DataFrame, id_col: str, text: str, size: int, overlap: int) -> DataFrame:
    """id, part, piece: paragraph_chunks() of every text, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(i, k, c) for i, t in zip(frame["id"], frame["t"], strict=True) for k, c in enumerate(paragraph_chunks(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["id", "part", "piece"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, part int, piece string")


_ITEM = re.compile(r"^\s*\(([a-z]+)\)\s*(.+)$", re.I)
_NUMBER = re.compile(r"^\s*(\d+)\.\s*(.*)$")
_ROMANS = {"i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"}


def list_drafts(text: str, locator: str) -> list[tuple[str, str]]:
    """(locator, clause) of each item of a lettered list with its introduction; at least two letters make a list."""
    return [(where, clause) for where, clause, _ in drafts_with_intro(text, locator)]


def drafts_with_intro(text: str, locator: str) -> list[tuple[str, str, str]]:
    """list_drafts() and the introduction of each."""
    number, intro, letter, found, letters = "1", "", None, [], set()
    for line in text.split("\n"):
        if m := _ITEM.match(line):
            mark, body = m.group(1).lower(), m.group(2).strip().rstrip(";,")
            if mark in _ROMANS and letter and not (mark == "i" and letter == "h"):
                found.append((f"{locator}:list:{number}-{letter[0]}-{mark}", " ".join(filter(None, [intro, letter[1].rstrip(":"), body])), intro))
                continue
            letter = (mark, body)
            letters.add(mark)
            if not body.endswith(":"):
                found.append((f"{locator}:list:{number}-{mark}", " ".join(filter(None, [intro, body])), intro))
        elif line.strip():
            m = _NUMBER.match(line)
            number, intro, letter = (m.group(1), m.group(2).strip().rstrip(":"), None) if m else (number, line.strip().rstrip(":"), None)
    return found if len(letters) >= 2 else []


def structured_items(df: DataFrame, id_col: str, text: str, locator: str, with_intro: bool = False) -> DataFrame:
    """id, ord, item_locator, clause (and intro): list_drafts() of every fragment, first wins on equal clauses."""
    names = ["id", "ord", "item_locator", "clause", *["intro"] * with_intro]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for i, t, loc in zip(frame["id"], frame["t"], frame["loc"], strict=True):
                seen: dict[str, tuple[str, str, str]] = {}
                for draft in drafts_with_intro(t, loc):
                    seen.setdefault(" ".join(draft[1].lower().split()), draft)
                rows += [(i, k, *draft)[: len(names)] for k, draft in enumerate(seen.values())]
            yield pd.DataFrame(rows, columns=names)

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(locator), F.lit("")).alias("loc"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, ord int, item_locator string, clause string" + ", intro string" * with_intro)


def cost_class(sources: Column, calls: Column, tokens: Column, over_budget: Column) -> Column:
    out = F.when(over_budget > 0, "very_large")
    for name, s, c, t in COST_CLASSES:
        out = out.when((sources >= s) | (calls >= c) | (tokens >= t), name)
    return out.otherwise("small")


def budget(docs: DataFrame, id_col: str, text: str, source: str, prompt_chars: int = 520 * 3) -> DataFrame:
    """Estimated model tokens by source: calls, total, largest, its document, over budget, cost class."""
    rows = docs.select(F.col(source).alias("source"), F.col(id_col).alias("id"), T.estimated_tokens(F.length(F.coalesce(F.col(text), F.lit(""))) + prompt_chars).alias("tokens"))
    by = rows.groupBy("source").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("total_tokens"), F.max("tokens").alias("max_tokens"), F.min_by("id", F.struct(-F.col("tokens"), F.col("id"))).alias("largest_id"), F.count_if(F.col("tokens") > PROMPT_TOKENS).alias("over_budget"))
    return by.withColumn("cost_class", cost_class(F.lit(1), F.col("calls"), F.col("max_tokens"), F.col("over_budget")))


def text_headings(docs: DataFrame, id_col: str, text_col: str, longest: int = 80, words: int = 10) -> DataFrame:
    """id, ord, heading, body of plain texts, cut at lines that look like headings: short, with a capital first, of few words, no item
    of a list and without a full stop at the end. What stands before the first one is the "Introduction"; headings without
    a body give no row. Null texts are empty.
    """
    ends = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n"), "\n")
    # Numbered before they are taken apart, so that rows of one id stay apart.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), ends.alias("lines"))
    lines = rows.select("row", "id", F.posexplode("lines").alias("nth", "line"))
    bare = F.regexp_replace("line", r"^\s+|\s+$", "")
    heading = (F.length(bare) < longest) & bare.rlike(r"^\p{Lu}") & ~F.endswith(bare, F.lit(".")) & (F.size(F.split(bare, r"\s+")) <= words)
    over = W.partitionBy("row").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    runs = lines.withColumn("heading", F.when(heading, bare)).withColumn("ord", F.count("heading").over(over))
    said = F.transform(F.sort_array(F.collect_list(F.when(F.col("heading").isNull(), F.struct("nth", "line")))), lambda x: x["line"])
    cut = runs.groupBy("row", "id", "ord").agg(F.coalesce(F.max("heading"), F.lit("Introduction")).alias("heading"), F.regexp_replace(F.array_join(said, "\n"), r"^\s+|\s+$", "").alias("body"))
    return cut.filter("body <> ''").drop("row")

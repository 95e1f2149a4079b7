"""Guidance pages: text lines out of HTML, and word differences between versions."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED, KEPT = {"nav", "aside", "script", "style", "header", "footer"}, {"p", "li", "h2", "h3"}


class _Lines(HTMLParser):
    """(section, tag, text) of paragraphs, list items and headings outside skipped tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str, str]] = []
        self.section, self.skip, self.open, self.held = "", 0, None, []

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if self.open and text:
            self.lines.append((self.section, self.open, text))
        self.open, self.held = None, []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in KEPT and not self.skip:
            self.flush()
            self.open = tag
            if tag == "h2":
                self.section = dict(attrs).get("id") or ""

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == self.open:
            self.flush()

    def handle_data(self, data):
        if self.open and not self.skip:
            self.held.append(data)


def html_lines(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, ord, section, tag, line for each line of each page; pages without lines give none. Null pages are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for i, html in zip(frame["id"], frame["html"], strict=True):
                parser = _Lines()
                parser.feed(html)
                parser.close()
                parser.flush()
                rows += [(i, k, *x) for k, x in enumerate(parser.lines)]
            yield pd.DataFrame(rows, columns=["id", "ord", "section", "tag", "line"])

    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, ord int, section string, tag string, line string")


def word_diff(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Adds words added, removed and kept between two text columns, by longest common blocks."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            u, v = (x or "").split(), (y or "").split()
            same = sum(m.size for m in difflib.SequenceMatcher(None, u, v, autojunk=False).get_matching_blocks())
            out.append((len(v) - same, len(u) - same, same))
        return pd.DataFrame(out, columns=["added", "removed", "kept"])

    diff = F.pandas_udf(run, "added int, removed int, kept int")
    return rows.withColumn("__d", diff(before, after)).select(*rows.columns, "__d.added", "__d.removed", "__d.kept")

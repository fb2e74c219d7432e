"""HTML to element and text rows, with the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style", "template", "noscript"))
#: Tags that close an open one of the same kind.
SELF_CLOSING = frozenset(("p", "li", "tr", "td", "th", "option", "dt", "dd"))
SCHEMA = "key long, ord int, parent int, depth int, tag string, role string, type string, name string, href string, path string, text string"
KINDS = [pa.int64(), *[pa.int32()] * 3, *[pa.string()] * 7]
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class _Pages(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # a section of no known kind is a comment, as in browsers
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SELF_CLOSING and self.open and self.rows[self.open[-1]][3] == tag:
            self.open.pop()
        a = dict(attrs)
        path = [self.rows[i][3] + (f"#{self.rows[i][9]}" if self.rows[i][9] else "") for i in self.open[-4:]]
        name = a.get("aria-label") or a.get("placeholder") or a.get("title") or a.get("alt")
        self.rows.append([len(self.rows), self.open[-1] if self.open else None, len(self.open), tag, a.get("role"), a.get("type"), name, a.get("href"), " > ".join([*path, tag]), a.get("id"), []])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[i]][3] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and not any(self.rows[i][3] in SILENT for i in self.open) and data.strip():
            self.rows[self.open[-1]][10].append(data)


def parse(html: str | None) -> list[tuple]:
    """(ord, parent, depth, tag, role, type, name, href, path, text) of each element in document order."""
    if not html:
        return []
    p = _Pages()
    p.feed(html)
    p.close()
    return [(*r[:9], " ".join(" ".join(r[10]).split()) or None) for r in p.rows]


def elements(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row for each element of each page; script and style content is no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in parse(t)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], NAMES)

    return df.select(F.col(key).cast("long").alias("k"), F.col(html).cast("string").alias("h")).where("h is not null").mapInArrow(run, SCHEMA)

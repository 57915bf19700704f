"""HTML tables as blocks and grids: Python's own parser in a table function, run once for each page."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_unit, normalize_text

_SKIPPED = {"script", "style"}


class _Tables(HTMLParser):
    """Collects tables as rows of (text, colspan, rowspan), captions, the document's title and texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []
        self.texts: list[str] = []
        self.title: list[str] | None = None
        self.in_title = self.skipped = 0

    def feed(self, data):
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", data))]
        self.size = len(data)
        super().feed(data)

    def _place(self) -> int:
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "table":
            self.open.append({"rows": [], "row": None, "cell": None, "caption": None, "in_caption": False, "texts": [], "start": self._place(), "end": self.size})
            self.tables.append(self.open[-1])
        elif tag == "title" and self.title is None:
            self.title, self.in_title = [], 1
        elif tag in _SKIPPED:
            self.skipped += 1
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                t["row"], t["cell"] = [], None
                t["rows"].append(t["row"])
            elif tag in ("td", "th") and t["row"] is not None:
                t["cell"] = [[], found.get("colspan"), found.get("rowspan")]
                t["row"].append(t["cell"])
            elif tag == "caption":
                t["in_caption"] = True
                t["caption"] = t["caption"] if t["caption"] is not None else []

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = 0
        elif tag in _SKIPPED and self.skipped:
            self.skipped -= 1
        elif self.open:
            t = self.open[-1]
            if tag == "table":
                self.open.pop()["end"] = self._place() + len("</table>")
            elif tag in ("td", "th"):
                t["cell"] = None
            elif tag == "tr":
                t["row"] = t["cell"] = None
            elif tag == "caption":
                t["in_caption"] = False

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif self.skipped or not data.strip():
            return
        self.texts.append(data)
        for t in self.open:
            t["texts"].append(data)
            if t["in_caption"]:
                t["caption"].append(data)
            elif t["cell"] is not None:
                t["cell"][0].append(data)


def _span(value: str | None) -> int:
    return max(int(value), 1) if value and re.fullmatch(r"\s*[+-]?\d+\s*", value) else 1


def _text(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def grid(rows: list[list]) -> list[list[str]]:
    """Rows with spans written out; blank rows are dropped. A span over several columns keeps all of them."""
    found, below = [], {}  # column -> (text, rows left)
    for row in rows:
        line: list[str] = []

        def fill(line=line):
            while len(line) in below:
                text, left = below.pop(at := len(line))
                line.append(text)
                if left > 1:
                    carried[at] = (text, left - 1)

        carried: dict[int, tuple[str, int]] = {}
        for parts, colspan, rowspan in row:
            fill()
            for _ in range(_span(colspan)):
                below.pop(len(line), None)
                if (n := _span(rowspan)) > 1:
                    carried[len(line)] = (_text(parts), n - 1)
                line.append(_text(parts))
        fill()
        below = below | carried
        if any(line):
            found.append(line)
    return found


def tables_of(html: str | None) -> tuple[str, str, list[dict]]:
    """Title, text and tables (caption, text, grid) of a page."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    tables = [{"caption": _text(t["caption"] or []), "text": _text(t["texts"]), "grid": grid(t["rows"]), "html": html[t["start"] : t["end"]]} for t in parser.tables]
    return _text(parser.title or []), _text(parser.texts), tables


_SCHEMA = "array<struct<title: string, page_text: string, table_index: int, caption: string, table_text: string, grid: array<array<string>>, html: string>>"


def html_tables(pages: DataFrame, *keys: str, html: str = "html") -> DataFrame:
    """keys, page_idx, title (caption, page title or ``HTML table n``), unit, grid, html: a row for each table of each page."""
    @F.pandas_udf(_SCHEMA)
    def parse(values: pd.Series) -> pd.Series:
        def one(page):
            title, text, tables = tables_of(page)
            return [{"title": title, "page_text": text, "table_index": i, "caption": t["caption"], "table_text": t["text"], "grid": t["grid"], "html": t["html"]} for i, t in enumerate(tables)]

        return values.map(one)

    t = pages.select(*keys, F.explode(parse(html)).alias("t")).select(*keys, "t.*")
    unit = F.coalesce(F.nullif(html_unit("table_text"), F.lit("")), html_unit("page_text"))
    title = F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.nullif(F.col("title"), F.lit("")), F.format_string("HTML table %d", F.col("table_index") + 1))
    return t.select(*keys, F.col("table_index").alias("page_idx"), title.alias("title"), unit.alias("unit"), "grid", "html")


def html_blocks(pages: DataFrame, key: str = "task_id", html: str = "html") -> DataFrame:
    """Blocks of HTML pages, as artifacts give them: a table block for each table, its place as its page."""
    t = html_tables(pages, key, html=html)
    unit = F.nullif(F.col("unit"), F.lit(""))
    content = F.struct(F.col("title").alias("table_caption"), F.col("html"), F.lit("html_table").alias("table_type"), F.lit(0).alias("table_nest_level"), unit.alias("unit"), unit.alias("table_footnote"))
    none = lambda name: F.lit(None).cast("string").alias(name)
    return t.select(F.col(key).alias("task_id"), F.col("page_idx").cast("long").alias("block_seq"), "page_idx", F.lit("table").alias("block_type"), none("bbox"), F.parse_json(F.to_json(content)).alias("content"), none("title"), none("text"))


def page_titles(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, title of each page, with built-in functions: the first title element, entities unescaped for the five of XML."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return pages.select(key, normalize_text(raw).alias("title"))

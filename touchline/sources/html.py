"""Pages: links, titles, tables, JSON-LD, embedded JSON (S-10 to S-12, UDF-03)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import plain_text

LD = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def links(html: Column) -> Column:
    """Targets of the page's anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href=["']([^"']*)["']"""), F.lit(1))


def text(html: Column) -> Column:
    return plain_text(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []
            self.tables[-1][-1].append((tag, self.cell))

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def rows_of_page(html: str) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Table number, row number and cells by header (or ``col<i>``) of every table row."""
    parser = _Tables()
    parser.feed(html or "")
    for t, table in enumerate(parser.tables):
        cells = [[(tag, " ".join("".join(c).split())) for tag, c in row] for row in table]
        header = [c for _, c in cells[0]] if cells and cells[0] and all(tag == "th" for tag, _ in cells[0]) else None
        for r, row in enumerate(cells[1:] if header else cells):
            if row:
                yield t, r, {(header[i].lower() if header and i < len(header) and header[i] else f"col{i}"): c for i, (_, c) in enumerate(row)}


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """S-10: ``key, table_no, row_no, cells`` (a map by header) of all tables of all pages."""

    def run(frames):
        for pdf in frames:
            out = [(k, t, r, c) for k, h in zip(pdf[key], pdf[html], strict=True) for t, r, c in rows_of_page(h)]
            yield pd.DataFrame(out, columns=["key", "table_no", "row_no", "cells"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"key {kind}, table_no int, row_no int, cells map<string,string>").withColumnRenamed("key", key)


def flatten(node) -> Iterator[dict]:
    """CJ-09: objects of nested lists and ``@graph``, in order."""
    if isinstance(node, list):
        for item in node:
            yield from flatten(item)
    elif isinstance(node, dict):
        if "@graph" in node:
            yield from flatten(node["@graph"])
        else:
            yield node


def linked_data(pages: DataFrame, key: str, html: str, kinds: list[str] | None = None) -> DataFrame:
    """S-11: ``key, kind, body`` of the JSON-LD objects of each page; broken blocks are skipped."""

    def run(frames):
        for pdf in frames:
            out = []
            for k, blocks in zip(pdf["key"], pdf["blocks"], strict=True):
                for block in blocks:
                    try:
                        node = json.loads(block)
                    except ValueError:
                        continue
                    for item in flatten(node):
                        types = item.get("@type")
                        for t in types if isinstance(types, list) else [types]:
                            if kinds is None or t in kinds:
                                out.append((k, t, json.dumps(item, sort_keys=True)))
            yield pd.DataFrame(out, columns=["key", "kind", "body"])

    found = pages.select(F.col(key).alias("key"), F.regexp_extract_all(html, F.lit(LD), F.lit(1)).alias("blocks")).where(F.size("blocks") > 0)
    return found.mapInPandas(run, f"key {pages.schema[key].dataType.simpleString()}, kind string, body string").withColumnRenamed("key", key)


def object_after(source: str, marker: str) -> str | None:
    """S-12: the balanced JSON object behind a marker; braces in strings do not count."""
    at = source.find(marker)
    start = source.find("{", at + len(marker)) if at >= 0 else -1
    if start < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(start, len(source)):
        ch = source[i]
        if skip:
            skip = False
        elif quoted:
            skip = ch == "\\"
            quoted = ch != '"'
        elif ch == '"':
            quoted = True
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if not depth:
                return source[start : i + 1]
    return None


def embedded_json(html: Column, marker: str) -> Column:
    @F.pandas_udf("string")
    def find(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: object_after(p, marker) if p else None)

    return find(html)

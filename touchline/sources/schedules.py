"""Schedule tables of pages (S-10): header keywords, dates carried down, statuses in cells.

A table function reads the tables of a page and names their cells; what the cells
mean is worked out by built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates, names

# Keywords of header cells in the order in which they are tried, with the column that they name;
# words of a time cell that are a status.
HEADERS = [
    ("match", "match_num"), ("time", "datetime"), ("date", "datetime"), ("home team", "home"), ("home", "home"), ("result", "score"), ("score", "score"),
    ("away team", "away"), ("away", "away"), ("division", "division"), ("bracket", "division"), ("group", "division"),
]
STATUS_WORDS = ["canceled", "cancelled", "rescheduled", "postponed", "forfeit", "ff", "field change"]
ZONE = r"\s+[A-Z]{2,4}$"

_ROW = "table_no int, row_no int, strategy string, match_num string, time_lines array<string>, home string, away string, score_text string, division string"
_SCORE = re.compile(classify.SCORE)
_DATE = re.compile(r"\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}|[A-Z][a-z]{2} \d{1,2},? \d{4}")


class _Cells(HTMLParser):
    """Rows of ``(is header, lines)`` of each table; a nested table is a table of its own."""

    def __init__(self):
        super().__init__()
        self.tables, self.open, self.cell = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self.cell = []
            self.open[-1][-1].append((tag == "th", self.cell))

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None and data.strip():
            self.cell.append(" ".join(data.split()))


#: Tags that a page may be made of to be read by ``_quick``, as they are written most often; attributes are skipped.
_TAG = re.compile(r"""<(/?)(table|thead|tbody|tfoot|tr|td|th|br|p|b|i|a|div|span|strong|em|html|body)(?:\s+[a-z][a-z-]*="[^"<>]*"|\s+[a-z][a-z-]*=[0-9]+(?=[\s>]))*[ \n]*>""", re.IGNORECASE)


def _quick(html: str) -> list | None:
    """The tables that ``_Cells`` finds, of a page of plain tags without entities, comments or scripts; else None."""
    parts = _TAG.split(html)
    texts = parts[::3]
    if "&" in html or html.count("<") != len(texts) - 1:
        return None
    tables, open_, cell = [], [], None
    for end, tag, text in zip(parts[1::3], parts[2::3], texts[1:], strict=True):
        tag = tag.lower()
        if tag == "td" or tag == "th":
            if end:
                cell = None
            elif open_ and open_[-1]:
                cell = []
                open_[-1][-1].append((tag == "th", cell))
        elif tag == "tr":
            if end:
                cell = None
            elif open_:
                open_[-1].append([])
        elif tag == "table":
            if not end:
                tables.append([])
                open_.append(tables[-1])
            else:
                cell = None
                if open_:
                    open_.pop()
        if cell is not None and text:
            words = text.split()
            if words:
                cell.append(" ".join(words))
    return tables


def _tables(html: str) -> list:
    found = _quick(html)
    if found is None:
        reader = _Cells()
        reader.feed(html)
        found = reader.tables
    return found


def columns_of(headers: list[str]) -> dict[str, int]:
    """Each header takes the first keyword it holds whose column is not taken yet."""
    found: dict[str, int] = {}
    for i, header in enumerate(headers):
        column = next((c for word, c in HEADERS if word in header and c not in found), None)
        if column:
            found[column] = i
    return found


def _by_header(table: list) -> Iterator[tuple] | None:
    """Rows of a table whose first row names a home and an away column; a date heading holds until the next."""
    at = columns_of([" ".join(lines).lower() for _, lines in table[0]]) if table else {}
    if "home" not in at or "away" not in at:
        return None

    def rows():
        heading: list[str] = []
        least = max(at["home"], at["away"])
        places = [at.get(c) for c in ("match_num", "home", "away", "score", "division")]
        time = at.get("datetime")
        for n, row in enumerate(table):
            cells = [lines for is_header, lines in row if not is_header]
            filled = [c for c in cells if c]
            if len(filled) == 1 and _DATE.search(" ".join(filled[0])):
                heading = filled[0]
            size = len(cells)
            if size <= least:
                continue
            number, home, away, score, division = [None if k is None or k >= size else " ".join(cells[k]) or None for k in places]
            when = cells[time] if time is not None and time < size else []
            yield n, "header", number, when or heading, home, away, score, division

    return rows()


def _by_score(table: list) -> Iterator[tuple] | None:
    """Rows without named columns: a score (or a dash) between two teams; dates are carried down."""

    def rows():
        heading: list[str] = []
        for n, row in enumerate(table):
            cells = [" ".join(lines) for _, lines in row]
            filled = [c for c in cells if c]
            if len(filled) == 1 and _DATE.search(filled[0]):
                heading = [filled[0]]
                continue
            k = next((k for k in range(1, len(cells) - 1) if _SCORE.match(cells[k]) or cells[k] in ("-", "vs", "vs.")), None)
            if k is not None:
                yield n, "score", None, heading, cells[k - 1] or None, cells[k + 1] or None, cells[k], None

    return rows()


#: Strategies in the order in which they are tried on a table; the first that takes it is used.
STRATEGIES = [_by_header, _by_score]


class ScheduleRows:
    """Table function: the rows of all schedule tables of a page."""

    def eval(self, html: str):
        for t, table in enumerate(_tables(html or "")):
            found = next((rows for rows in (s(table) for s in STRATEGIES) if rows is not None), iter(()))
            for n, *row in found:
                yield t, n, *row


def status(tag: Column, score_text: Column, home: Column, away: Column) -> Column:
    """Status by the tag in the time cell, else by a forfeit in the score, else by whether there are scores."""
    low = F.lower(F.trim(tag))
    return (
        F.when(low.contains("final") | low.contains("complete") | (low == "fin"), "final").when(low.contains("cancel"), "cancelled").when(low.contains("forfeit") | (low == "ff"), "forfeit")
        .when(low.contains("postpon"), "postponed").when(score_text.rlike(r"(?i)\b(ff|forfeit)\b|^\s*F\s+\d"), "forfeit").when(home.isNotNull() & away.isNotNull(), "final").otherwise("scheduled")
    )


def schedule(pages: DataFrame, key: str, html: str) -> DataFrame:
    """S-10: matches of all schedule tables: ``key, table_no, row_no, strategy, match_num, home, away, home_score, away_score, match_date, status, division, age_group, gender``.

    Rows of a bye, without a team, or with a team that has no canonical name are left out.
    """
    table = F.udtf(ScheduleRows, returnType=_ROW)
    rows = pages.select(F.col(key).alias("_key"), F.col(html).alias("_html")).lateralJoin(table(F.col("_html").outer()))
    bye = lambda c: F.col(c).rlike(r"(?i)^\s*bye\s*$")
    rows = rows.where("home IS NOT NULL AND away IS NOT NULL").where(~bye("home") & ~bye("away") & names.has_canonical_name(F.col("home")) & names.has_canonical_name(F.col("away")))
    is_status = lambda line: F.exists(F.lit(STATUS_WORDS), lambda w: F.contains(F.lower(line), w))
    tag = F.try_element_at(F.filter("time_lines", is_status), F.lit(-1))
    when = F.trim(F.regexp_replace(F.array_join(F.filter("time_lines", lambda line: ~is_status(line)), " "), ZONE, ""))
    plain = lambda k: F.nullif(F.regexp_extract("score_text", r"^(\d{1,2})\s*-\s*(\d{1,2})$", k), F.lit("")).try_cast("int")
    loose = classify.score(F.col("score_text"))
    by_header = F.col("strategy") == "header"
    home, away = F.when(by_header, plain(1)).otherwise(loose["home"]), F.when(by_header, plain(2)).otherwise(loose["away"])
    # Read once, used by several columns.
    rows = rows.withColumns({"_home": home, "_away": away, "_tag": tag, "_when": when, "_side": classify.bracket(F.coalesce("division", F.lit("")))})
    return rows.select(
        F.col("_key").alias(key), "table_no", "row_no", "strategy", "match_num", "home", "away", F.col("_home").alias("home_score"), F.col("_away").alias("away_score"), dates.parse_date(F.col("_when")).alias("match_date"),
        status(F.col("_tag"), F.col("score_text"), F.col("_home"), F.col("_away")).alias("status"), "division", F.col("_side.age_group").alias("age_group"), F.col("_side.gender").alias("gender"),
    )

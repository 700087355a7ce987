"""Dates, seasons, ages and graduation years."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats in the order in which they are tried.
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy h:mm a", "M/d/yyyy H:mm", "M/d/yyyy", "MMM d yyyy h:mm a", "MMM d, yyyy h:mm a", "MMM d, yyyy"]


def _may_be(text: Column, form: str) -> Column:
    """Whether the text holds the marks that ``form`` needs and none of those that it cannot take."""
    holds = [F.contains(text, F.lit(m)) if m in form else ~F.contains(text, F.lit(m)) for m in "/,:"]
    return reduce(lambda a, b: a & b, [*holds, *(F.contains(text, F.lit(m)) for m in "-T" if m in form)])


def parse_date(c: Column, formats: list[str] = FORMATS) -> Column:
    """DT-01: the first format that parses; a weekday before a comma is skipped.

    A format that fails costs an exception, so only those whose marks fit are tried.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,\s*", ""))
    return F.coalesce(*(F.when(_may_be(text, f), F.try_to_timestamp(text, F.lit(f))) for f in formats)).cast("timestamp_ntz")


def academic_year(d: Column) -> Column:
    """DT-02: ``2024-25`` for dates from August 2024 to July 2025."""
    start = F.when(F.month(d) >= 8, F.year(d)).otherwise(F.year(d) - 1)
    return F.when(d.isNotNull(), F.format_string("%d-%02d", start, F.pmod(start + 1, F.lit(100))))


def seasons_back(first: Column, count: int) -> Column:
    """DT-03: academic years from that of ``first`` (its starting year) backwards."""
    return F.transform(F.sequence(first, first - (count - 1), F.lit(-1)), lambda y: F.format_string("%d-%02d", y, F.pmod(y + 1, F.lit(100))))


def season_of_text(c: Column) -> Column:
    """DT-04: ``20YY-YY`` in the text, else the season that ends in its single year."""
    pair = F.nullif(F.regexp_replace(F.regexp_extract(c, r"20\d{2}[-–]\d{2}", 0), "–", "-"), F.lit(""))
    year = F.nullif(F.regexp_extract(c, r"(20\d{2})", 1), F.lit("")).try_cast("int")
    return F.coalesce(pair, F.when(year.isNotNull(), F.format_string("%d-%02d", year - 1, F.pmod(year, F.lit(100)))))


def grad_year_of_birth_date(d: Column) -> Column:
    """DT-05: 18 years on, 19 from August."""
    return F.year(d) + F.when(F.month(d) >= 8, 19).otherwise(18)


def grad_year_of_birth_month(year: Column, month: Column) -> Column:
    """DT-06: 18 years on, 19 after August."""
    return year + 18 + F.when(month > 8, 1).otherwise(0)


# Years until graduation, from the start of the school year.
GRADE_YEARS = {
    "fr": 4, "freshman": 4, "9": 4, "9th": 4,
    "so": 3, "sophomore": 3, "10": 3, "10th": 3,
    "jr": 2, "junior": 2, "11": 2, "11th": 2,
    "sr": 1, "senior": 1, "12": 1, "12th": 1,
}


def grad_year_of_grade(grade: Column, spring: Column) -> Column:
    """DT-07: a year in the cell wins; else by the whole cell as a grade in the school year that ends in ``spring``."""
    cell = F.replace(F.lower(F.trim(grade)), F.lit("."), F.lit(""))
    explicit = F.nullif(F.regexp_extract(cell, r"\b(20\d{2})\b", 1), F.lit("")).try_cast("int")
    table = F.create_map(*(F.lit(x) for pair in GRADE_YEARS.items() for x in pair))
    return F.coalesce(explicit, spring + F.try_element_at(table, cell) - 1)


# Fixed values.
CLASS_YEARS = {"fr": "freshman", "freshman": "freshman", "so": "sophomore", "sophomore": "sophomore", "jr": "junior", "junior": "junior", "sr": "senior", "senior": "senior", "gr": "grad", "grad": "grad", "graduate": "grad", "5th": "grad", "5th yr": "grad", "5th year": "grad"}


def class_year(c: Column) -> Column:
    """DT-08: class year of a roster cell; points and a redshirt mark before it are skipped."""
    word = F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("."), F.lit("")), r"^(rs-|rs |r-)", "")
    table = F.create_map(*(F.lit(x) for pair in CLASS_YEARS.items() for x in pair))
    return F.try_element_at(table, word)


def day(ts: Column) -> Column:
    """DT-09."""
    return F.date_format(ts, "yyyy-MM-dd")


def within_days(ts: Column, as_of: str, days: int) -> Column:
    """DT-10: not older than so many days at ``as_of``."""
    return ts >= F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))


def cadence_days(month: Column) -> Column:
    """DT-12: weekly in August and September, monthly to January, else quarterly."""
    return F.when(month.isin(8, 9), 7).when(month.isin(10, 11, 12, 1), 30).otherwise(90)


def is_due(last: Column, as_of: str) -> Column:
    now = F.lit(as_of).cast("date")
    return last.isNull() | (F.datediff(now, last) >= cadence_days(F.month(now)))


def date_range(c: Column) -> Column:
    """DT-13: ``Jan 2 - Jan 5, 2026``, ``Jan 2-5, 2026``, ``Jan 2, 2026`` as first and last date."""
    pattern = r"^\s*([A-Za-z]{3})[a-z]*\.?\s+([0-9]{1,2})(?:\s*[-–]\s*(?:([A-Za-z]{3})[a-z]*\.?\s+)?([0-9]{1,2}))?,?\s+([0-9]{4})\s*$"
    part = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    to_date = lambda m, d: F.try_to_timestamp(F.concat_ws(" ", F.initcap(m), d, part(5)), F.lit("MMM d yyyy")).cast("date")
    first = F.when(part(2).isNotNull(), to_date(part(1), part(2)))
    last = F.when(part(4).isNotNull(), to_date(F.coalesce(part(3), part(1)), part(4))).otherwise(first)
    return F.struct(first.alias("first"), last.alias("last"))


def age_of_division(division: Column, season: Column) -> Column:
    """DT-14: ``U17`` for ``G2008/2007`` in ``2024-25``: the first birth year against the season's first year, at least 1."""
    born = F.nullif(F.regexp_extract(division, r"(?i)[BG](\d{4})", 1), F.lit("")).try_cast("int")
    start = F.nullif(F.regexp_extract(season, r"^(\d{4})", 1), F.lit("")).try_cast("int")
    return F.when(born.isNotNull() & start.isNotNull(), F.concat(F.lit("U"), F.greatest(F.lit(1), start - born + 1).cast("string")))

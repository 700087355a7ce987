"""Filters, search, sorting and paging (F-*, O-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import escape_like


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """F-01: AND of the conditions that are given; none, no filter."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def like_any_case(c: Column, text: str | None) -> Column | None:
    """F-02: the text is a pattern."""
    return None if text is None else c.ilike(f"%{text}%")


def contains_any_case(c: Column, text: str | None) -> Column | None:
    """F-03: the text is literal."""
    return None if text is None else c.ilike(f"%{escape_like(text)}%")


def equals_any_case(c: Column, text: str | None) -> Column | None:
    """F-04."""
    return None if text is None else F.lower(c) == text.lower()


def first_given_like(own: Column, other: Column, text: str | None) -> Column | None:
    """F-05: the own value where it has one, else the other's."""
    return None if text is None else F.coalesce(own, other).ilike(f"%{escape_like(text)}%")


def either_is(a: Column, b: Column, value) -> Column | None:
    """F-06."""
    return None if value is None else (a == value) | (b == value)


def between(c: Column, first: str | None, last: str | None) -> Column | None:
    """F-07: inclusive; a text that is no date raises ValueError."""
    from datetime import datetime

    bounds = []
    for text, op in ((first, c.__ge__), (last, c.__le__)):
        if text is not None:
            bounds.append(op(F.lit(datetime.fromisoformat(text)).cast("timestamp_ntz")))
    return reduce(lambda a, b: a & b, bounds) if bounds else None


def past(c: Column, as_of: str) -> Column:
    """F-08."""
    return c <= F.lit(as_of).cast("timestamp_ntz")


def upcoming(c: Column, as_of: str) -> Column:
    return c.isNotNull() & (c >= F.lit(as_of).cast("timestamp_ntz"))


def active(status: Column) -> Column:
    """F-09."""
    return (status == "active") | status.isNull()


def present(c: Column, wanted: bool | None) -> Column | None:
    """F-10: present (neither null nor empty), absent, or no filter."""
    if wanted is None:
        return None
    return (c.isNotNull() & (c != "")) if wanted else (c.isNull() | (c == ""))


def at_least(c: Column, value) -> Column | None:
    """F-11, F-23."""
    return None if value is None else c >= value


def in_ids(c: Column, ids: list, most: int = 100) -> Column:
    """F-12: at most ``most`` integer ids."""
    if len(ids) > most or not all(isinstance(i, int) and not isinstance(i, bool) for i in ids):
        raise ValueError(f"at most {most} integer ids")
    return c.isin(ids) if ids else F.lit(False)


def outside_domain(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """F-13: rows with a value outside its domain, as ``column, value`` beside the row's columns."""
    bad = F.filter(F.array(*(F.when(F.col(c).isNotNull() & ~F.col(c).isin(v), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, v in domains.items())), lambda x: x.isNotNull())
    return df.withColumn("_bad", F.explode(bad)).select(*df.columns, "_bad.column", "_bad.value")


def same(a: Column, b: Column) -> Column:
    """F-14."""
    return a.eqNullSafe(b)


def matches(c: Column, pattern: str, any_case: bool = False) -> Column:
    """F-15."""
    return c.rlike(("(?i)" if any_case else "") + pattern)


def kind_of_prefix(c: Column, prefixes: list[tuple[str, str]]) -> Column:
    """F-16: the kind of the first prefix."""
    out = None
    for prefix, kind in prefixes:
        out = F.when(c.startswith(prefix), kind) if out is None else out.when(c.startswith(prefix), kind)
    return out


# Fixed values.
STATUS_ALIASES = {"success": ["ok", "partial"], "failure": ["failed"]}


def status_is(c: Column, name: str | None, known: list[str], strict: bool = False) -> Column | None:
    """F-17, F-18: aliases; an unknown name filters nothing, or everything where ``strict``."""
    if name is None:
        return None
    if name in STATUS_ALIASES:
        return c.isin(STATUS_ALIASES[name])
    if name in known:
        return c == name
    return F.lit(False) if strict else None


def not_listed(df: DataFrame, key: str, listed: DataFrame, listed_key: str, any_case: bool = False) -> DataFrame:
    """F-19, ER-06: rows whose key is not in the list; a null key stays."""
    f = F.lower if any_case else (lambda x: x)
    keys = listed.select(f(F.col(listed_key)).alias("_key")).where("_key IS NOT NULL").distinct()
    return df.join(keys, f(df[key]) == keys["_key"], "left_anti")


def not_true(c: Column) -> Column:
    """F-20."""
    return ~F.coalesce(c, F.lit(False))


def clamp_page(page: int | None, size: int | None, most: int = 100, default: int = 20) -> tuple[int, int]:
    """F-21."""
    return max(1, page or 1), min(most, max(1, default if size is None else size))


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """F-22."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def split_valid(df: DataFrame, rules: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """F-24, F-25, W-25: rows that pass, and the others with the first reason (``reason``)."""
    reason = None
    for bad, name in rules:
        bad = F.coalesce(bad, F.lit(True))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    tagged = df.withColumn("reason", reason)
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def nulls_as_in_sql(c: Column, descending: bool = False) -> Column:
    """O-03: nulls last when ascending, first when descending."""
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """O-06; ``order`` must end in a unique column."""
    number, size = clamp_page(number, size)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def with_total(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """WN-03: a page with the number of all rows; that is counted apart, so that no window takes all rows to one task."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, number, size).crossJoin(F.broadcast(total))


def ranked_search(df: DataFrame, column: str, text: str, key: str, size: int = 25) -> DataFrame:
    """O-05: names that begin with the text before those that hold it."""
    literal = escape_like(text)
    found = df.where(F.col(column).ilike(f"%{literal}%"))
    rank = F.when(F.col(column).ilike(f"{literal}%"), 0).when(F.col(column).ilike(f"%{literal}%"), 1).otherwise(2)
    return found.withColumn("rank", rank).orderBy("rank", column, key).limit(size)


def latest_in_order(df: DataFrame, column: str, key: str, size: int) -> DataFrame:
    """O-07: the most recent rows, oldest first."""
    return df.orderBy(F.col(column).desc_nulls_last(), F.col(key).desc()).limit(size).orderBy(F.col(column).asc(), F.col(key).asc())

"""Aggregations (A-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    """A-04, A-05."""
    return F.count_if(condition)


def distinct_where(column: Column, condition: Column) -> Column:
    """A-06."""
    return F.countDistinct(F.when(condition, column))


def sum_where(column: Column, condition: Column) -> Column:
    """A-07: 0 where nothing counts."""
    return F.coalesce(F.sum(F.when(condition, column)), F.lit(0))


def ordered_list(column: str, by: str) -> Column:
    """A-11: values in the order of another column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), F.col(column).alias("value")))), lambda s: s["value"])


def distinct_list(column: str | Column) -> Column:
    """A-12."""
    return F.array_sort(F.collect_set(column))


def joined_list(column: str | Column, separator: str = ", ") -> Column:
    """A-13."""
    return F.array_join(distinct_list(column), separator)


def json_list(columns: list[Column], order: list[str]) -> Column:
    """A-14: a JSON array of objects, nulls kept, in order of leading fields."""
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"_{i}") for i, o in enumerate(order)), F.struct(*columns).alias("row"))))
    return F.to_json(F.transform(rows, lambda s: s["row"]), {"ignoreNullFields": "false"})


def percent(part: Column, whole: Column) -> Column:
    """A-20: percentage of one decimal; 0 of nothing."""
    return F.when(whole > 0, F.floor(part / whole * 1000 + 0.5) / 10).otherwise(0.0)


def pivot_counts(df: DataFrame, key: str, status: str, known: list[str]) -> DataFrame:
    """A-19: a column for each known status; unknown ones count in ``total`` only."""
    return df.groupBy(key).agg(*(F.count_if(F.col(status) == s).alias(s) for s in known), F.count("*").alias("total"))


def most_frequent(df: DataFrame, column: str, n: int) -> DataFrame:
    """A-21: ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(n)


def completeness(columns: list[str]) -> Column:
    """A-23: how many columns are neither null nor blank."""
    return reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), 1).otherwise(0) for c in columns))


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """A-24: one row for each table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in frames.items()))


def keep_last(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """A-25, WN-02: of each key the last row by ``order`` (descending columns)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def merge_first(df: DataFrame, key: Column, order: str, columns: list[str]) -> DataFrame:
    """A-26: for each column the first value that is not blank, by input order."""
    first = lambda c: F.min_by(F.col(c), F.when(F.nullif(F.trim(c), F.lit("")).isNotNull(), F.col(order))).alias(c)
    return df.groupBy(key.alias("key")).agg(*(first(c) for c in columns))


def grouped_casefold(df: DataFrame, group: list[str], name: str, key: str) -> DataFrame:
    """A-22: size, greatest id, and names different but for case, each in its first casing."""
    by_name = df.groupBy(*group, F.lower(F.trim(name)).alias("_f")).agg(F.min_by(F.trim(name), key).alias("_first"), F.count("*").alias("_n"), F.max(key).alias("_max"))
    return by_name.groupBy(*group).agg(F.sum("_n").alias("n"), F.max("_max").alias("max_id"), F.array_sort(F.collect_list("_first")).alias("names"))


def standings(matches: DataFrame, scope: Column | None = None, keys: tuple[str, ...] = ("season", "league", "division", "age_group", "gender")) -> DataFrame:
    """Q-20: wins, losses, draws and goals of both sides of final matches.

    One pass: each match becomes its two sides by an explode, so the input is read
    once. Null keys make groups of their own.
    """
    played = matches.where((F.col("status") == "final") & F.col("home_club_id").isNotNull() & F.col("away_club_id").isNotNull() & F.col("home_score").isNotNull() & F.col("away_score").isNotNull() & F.col("season").isNotNull())
    if scope is not None:
        played = played.where(scope)
    side = lambda own, other: F.struct(F.col(f"{own}_club_id").alias("club_id"), F.col(f"{own}_score").alias("gf"), F.col(f"{other}_score").alias("ga"))
    sides = played.select(*keys, F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select(*keys, "s.*")
    return sides.groupBy("club_id", *keys).agg(
        F.count_if(F.col("gf") > F.col("ga")).alias("wins"), F.count_if(F.col("gf") < F.col("ga")).alias("losses"), F.count_if(F.col("gf") == F.col("ga")).alias("draws"),
        F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"), F.count("*").alias("matches_played"),
    )


def unlinked_matches(matches: DataFrame) -> DataFrame:
    """Q-20: final matches with scores that wait for a club on a side."""
    return matches.where((F.col("status") == "final") & (F.col("home_club_id").isNull() | F.col("away_club_id").isNull()) & F.col("home_score").isNotNull() & F.col("away_score").isNotNull()).agg(F.count("*").alias("skipped"))

"""Windows (WN-*) and retention (W-16 to W-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WN-01, WN-02: the first row of each key by ``order``."""
    return top_n(df, keys, order, 1)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """WN-06, W-17: at most ``n`` rows of each key (limited before the shuffle by the planner)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def failure_streak(df: DataFrame, key: str, time: str, tie: str, failed: Column) -> DataFrame:
    """WN-05, ST-05: failures since the last row that is none, without a window.

    The time of the last success of each key is an aggregate; failures after it
    count. Both combine on the map side, so a hot key is no burden.
    """
    at = F.struct(F.col(time), F.col(tie))
    last_good = df.groupBy(key).agg(F.max(F.when(~failed, at)).alias("_good"))
    joined = df.where(failed).join(last_good, key)
    counted = joined.where(F.col("_good").isNull() | (at > F.col("_good"))).groupBy(key).agg(F.count("*").alias("streak"))
    return last_good.select(key).join(counted, key, "left").select(key, F.coalesce("streak", F.lit(0)).cast("long").alias("streak"))


def prune_older(df: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """W-16: rows that are kept."""
    return df.where(F.col(time) >= F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))


def delete_limited(df: DataFrame, condition: Column, key: str, n: int) -> DataFrame:
    """W-18: all rows but the first ``n`` that meet the condition."""
    doomed = df.where(condition).orderBy(key).limit(n).select(key)
    return df.join(doomed, key, "left_anti")


def rolling_median(df: DataFrame, keys: list[str], day: str, value: str, days: int = 7) -> DataFrame:
    """K-06: median of the days before each day."""
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-days, -1)
    n, at = F.size("_v"), lambda i: F.try_element_at("_v", F.floor(i).cast("int")).cast("double")
    df = df.withColumn("_day", number).withColumn("_v", F.array_sort(F.collect_list(value).over(w)))  # a few days' values
    return df.withColumn("median", F.when(n > 0, (at((n + 1) / 2) + at((n + 2) / 2)) / 2)).drop("_day", "_v")

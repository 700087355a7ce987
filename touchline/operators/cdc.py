"""Snapshot diffs and change events (CDC-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import previous_snapshot


def snapshot_diff(df: DataFrame, group: list[str], at: str, entity: str, fields: list[str]) -> DataFrame:
    """CDC-01: changes from each snapshot of a group to the next.

    ``added``, ``removed`` and one row ``<field>_changed`` for each field with
    another value; null and empty are the same. A group's first snapshot gives none.
    """
    dates = previous_snapshot(df, group, at)
    rows = df.select(*group, at, entity, *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields)).dropDuplicates([*group, at, entity])
    now = rows.join(dates.where("previous IS NOT NULL").drop("previous"), [*group, at]).withColumnRenamed(at, "_at")
    before = rows.withColumnRenamed(at, "previous").join(dates.where("previous IS NOT NULL"), [*group, "previous"]).drop("previous").withColumnRenamed(at, "_at")
    keys = [*group, "_at", entity]
    now = now.select(*keys, F.struct(*fields).alias("n"))
    before = before.select(*keys, F.struct(*fields).alias("o"))
    both = now.join(before, keys, "full")
    change = lambda kind, f=None: F.struct(F.lit(kind).alias("diff_type"), (F.col(f"o.{f}") if f else F.lit(None).cast("string")).alias("from_value"), (F.col(f"n.{f}") if f else F.lit(None).cast("string")).alias("to_value"))
    changes = F.when(F.col("o").isNull(), F.array(change("added"))).when(F.col("n").isNull(), F.array(change("removed"))).otherwise(
        F.filter(F.array(*(F.when(F.col(f"o.{f}") != F.col(f"n.{f}"), change(f"{f}_changed", f)) for f in fields)), lambda x: x.isNotNull())
    )
    return both.select(*group, F.col("_at").alias(at), entity, F.explode(changes).alias("c")).select(*group, at, entity, "c.*")


def movements(career: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """CDC-02, Q-22: ``joined`` for current and ``departed`` for past careers without such an event yet."""
    events = career.select(*keys, F.when(F.col("is_current"), "joined").otherwise("departed").alias("event_type")).distinct()
    seen = known.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("event_type").alias("_e")).distinct()
    return events.join(seen, [*(events[k].eqNullSafe(seen[f"_{k}"]) for k in keys), events["event_type"] == seen["_e"]], "left_anti")


def seen_span(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """CDC-03."""
    return df.groupBy(*keys).agg(F.min(time).alias("first_seen_at"), F.max(time).alias("last_seen_at"))

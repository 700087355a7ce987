"""Merges, splits and cutovers over all tables that refer to an entity (ER-13, ER-14, ER-16, ER-20), with counts.

Many merges or splits go at once; what a loop of one after the other would leave is
what comes out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .entity import resolve_chains
from .joins import union_all
from .lineage import cut
from .upsert import upsert

#: Of the aliases that a merge writes (fixed value).
SOURCE = "merger-auto"


@dataclass
class Reference:
    """A column of a table that holds entity ids; ``unique``: the other columns of a unique key; ``when``: rows that do."""

    table: str
    column: str
    unique: list[str] | None = None
    when: Column | None = None


def _redirected(frame: DataFrame, ref: Reference, final: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``frame`` after the redirect, and ``loser, deleted`` of its rows that moved.

    Of rows that come to have the same unique key, the winner's own stays, else that of
    the least loser; null parts of a key never collide.
    """
    side = final.select(F.col("loser").alias("_loser"), F.col("winner").alias("_winner"))
    meets = frame[ref.column] == side["_loser"]
    j = frame.join(side, meets if ref.when is None else meets & ref.when, "left").withColumn("_to", F.coalesce("_winner", ref.column))
    if ref.unique:
        scope = F.lit(True) if ref.when is None else F.coalesce(ref.when, F.lit(False))
        whole = F.lit(True)
        for u in ref.unique:
            whole = whole & F.col(u).isNotNull()
        first = Window.partitionBy("_to", *ref.unique, scope).orderBy(F.col("_loser").asc_nulls_first())
        j = j.withColumn("_deleted", F.col("_loser").isNotNull() & whole & (F.row_number().over(first) > 1))
    else:
        j = j.withColumn("_deleted", F.lit(False))
    j = cut(j)
    moved = j.where("_loser IS NOT NULL").select(F.col("_loser").alias("loser"), F.col("_deleted").alias("deleted"))
    kept = j.where("NOT _deleted").withColumn(ref.column, F.col("_to").cast(frame.schema[ref.column].dataType)).select(*frame.columns)
    return kept, moved


def merge_clubs(clubs: DataFrame, aliases: DataFrame, tables: dict[str, DataFrame], references: list[Reference], losers: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """ER-13: all tables after the merges, what became of each, and the rows moved.

    ``clubs (id, name, manually_merged, ...)``, ``aliases (club_id, alias, source,
    merged_from)``, ``losers (loser, winner)``. Skipped with a reason: a merge with
    itself, an absent winner or loser, a manually merged club on either side. Winners
    that lose elsewhere are followed to the end; a circle raises ValueError. Each loser's
    name becomes an alias of its winner unless that has it. Returns the frames (with
    ``clubs`` and ``aliases``), ``loser, winner, reason`` (null: merged) and ``place,
    redirected, deleted``.
    """
    state = lambda s: clubs.select(F.col("id").alias(f"_{s}"), F.col("name").alias(f"_{s}_name"), F.coalesce("manually_merged", F.lit(False)).alias(f"_{s}_pinned"))
    known = losers.join(state("l"), losers["loser"] == F.col("_l"), "left").join(state("w"), losers["winner"] == F.col("_w"), "left")
    reason = (
        F.when(F.col("loser") == F.col("winner"), "same id").when(F.col("_w").isNull(), "winner not found").when(F.col("_l").isNull(), "loser already absent")
        .when(F.col("_l_pinned") | F.col("_w_pinned"), "manually merged")
    )
    judged = cut(known.withColumn("reason", reason))
    final = cut(resolve_chains(judged.where("reason IS NULL").select("loser", "winner")))
    out, counts = dict(tables), []
    for ref in references:
        out[ref.table], moved = _redirected(out[ref.table], ref, final)
        counts.append(moved.groupBy(F.lit(f"{ref.table}.{ref.column}").alias("place")).agg(F.count_if(~F.col("deleted")).alias("redirected"), F.count_if("deleted").alias("deleted")))
    named = final.join(clubs.select(F.col("id").alias("_id"), F.col("name").alias("alias")), F.col("loser") == F.col("_id")).where("alias IS NOT NULL")
    fresh = named.groupBy(F.col("winner").alias("club_id"), "alias").agg(F.min("loser").alias("merged_from"))
    held, _ = _redirected(aliases, Reference("aliases", "club_id", ["alias"]), final)
    taken = held.select(F.col("club_id").alias("_c"), F.col("alias").alias("_a")).distinct()
    fresh = fresh.join(taken, (fresh["club_id"] == taken["_c"]) & (fresh["alias"] == taken["_a"]), "left_anti")
    out["aliases"] = held.unionByName(fresh.select(F.col("club_id").cast(aliases.schema["club_id"].dataType).alias("club_id"), "alias", F.lit(SOURCE).alias("source"), "merged_from"), allowMissingColumns=True)
    out["clubs"] = clubs.join(final, clubs["id"] == final["loser"], "left_anti")
    return out, judged.select("loser", "winner", "reason"), union_all(counts) if counts else None


def merge_reviewed(clubs: DataFrame, tables: dict[str, DataFrame], references: list[Reference], pairs: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """ER-14, Q-39: decided pairs of a review queue: ``a, b, winner`` with status ``pending``.

    All references of the loser move without a look at collisions, the loser goes, the
    winner is marked ``manually_merged`` and the pair ``merged``; pairs that are not
    pending, or whose winner is neither side, stay as they are.
    """
    ready = (F.col("status") == "pending") & (F.col("winner") == F.col("a")) | (F.col("status") == "pending") & (F.col("winner") == F.col("b"))
    ready = F.coalesce(ready, F.lit(False))
    chosen = pairs.where(ready).select(F.when(F.col("winner") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("loser"), "winner")
    final = cut(resolve_chains(chosen.groupBy("loser").agg(F.min("winner").alias("winner"))))
    out = dict(tables)
    for ref in references:
        out[ref.table] = _redirected(out[ref.table], Reference(ref.table, ref.column, None, ref.when), final)[0]
    winners = final.select(F.col("winner").alias("_won")).distinct()
    kept = clubs.join(final, clubs["id"] == final["loser"], "left_anti").join(winners, clubs["id"] == winners["_won"], "left")
    out["clubs"] = kept.withColumn("manually_merged", F.coalesce("manually_merged", F.lit(False)) | F.col("_won").isNotNull()).select(*clubs.columns)
    return out, pairs.withColumn("status", F.when(ready, "merged").otherwise(F.col("status")))


def split_clubs(clubs: DataFrame, aliases: DataFrame, tables: dict[str, DataFrame], references: list[tuple[str, str, str]], splits: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """ER-16: over-collapsed clubs taken apart by the stripped root of the raw names.

    ``splits (source_id, root, new_name)``: each makes a club of that name with the
    source's state; aliases and rows of every ``(table, id column, raw column)`` whose raw
    name has the root move to it, all others stay. Splits of absent clubs are skipped.
    New ids follow the greatest, by source and root. Returns the frames (with ``clubs``
    and ``aliases``), the new clubs and ``place, root, moved``.
    """
    side = clubs.select(F.col("id").alias("_id"), F.col("state").alias("_state"))
    top = clubs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    asked = splits.select("source_id", F.lower(F.trim("root")).alias("root"), "new_name").where("root <> ''").dropDuplicates(["source_id", "root"])
    asked = asked.join(side, asked["source_id"] == side["_id"])
    made = cut(asked.select("source_id", "root", F.col("new_name").alias("name"), F.col("_state").alias("state"), (F.row_number().over(Window.orderBy("source_id", "root")) + top).alias("id")))  # one row for each split asked for

    def moved(frame: DataFrame, column: str, raw: str) -> tuple[DataFrame, DataFrame]:
        to = made.select(F.col("source_id").alias("_s"), F.col("root").alias("_r"), F.col("id").alias("_new"))
        j = frame.withColumn("_root", F.lower(names.without_team_words(F.col(raw))))
        j = cut(j.join(to, (j[column] == to["_s"]) & (j["_root"] == to["_r"]), "left"))
        return j.withColumn(column, F.coalesce(F.col("_new").cast(frame.schema[column].dataType), F.col(column))).select(*frame.columns), j.where("_new IS NOT NULL").groupBy(F.col("_r").alias("root")).agg(F.count("*").alias("moved"))

    out, counts = dict(tables), []
    out["aliases"], n = moved(aliases, "club_id", "alias")
    counts.append(n.select(F.lit("aliases.club_id").alias("place"), "root", "moved"))
    for table, column, raw in references:
        out[table], n = moved(out[table], column, raw)
        counts.append(n.select(F.lit(f"{table}.{column}").alias("place"), "root", "moved"))
    fresh = made.select(F.col("id").cast(clubs.schema["id"].dataType).alias("id"), "name", "state")
    out["clubs"] = clubs.unionByName(fresh, allowMissingColumns=True)
    return out, made, union_all(counts)


def apply_rehash(groups: DataFrame, people: DataFrame, discoveries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ER-20: the cutover that ``entity.rehash`` asks for: people, discoveries and audit rows afterwards.

    Discoveries of the losers move to the winner, losers go, winners get the new
    ``person_hash``. Audit: ``winner_id, loser_id, person_hash, moved``.
    """
    losers = cut(groups.where("id <> winner_id").select(F.col("id").alias("loser"), F.col("winner_id").alias("winner"), "person_hash"))
    kept, _ = _redirected(discoveries, Reference("discoveries", "person_id"), losers)
    n = discoveries.groupBy(F.col("person_id").alias("_p")).agg(F.count("*").alias("_n"))
    audit = losers.join(n, losers["loser"] == n["_p"], "left").select(F.col("winner").alias("winner_id"), F.col("loser").alias("loser_id"), "person_hash", F.coalesce("_n", F.lit(0)).alias("moved"))
    new = groups.where("id = winner_id").select(F.col("id").alias("_id"), F.col("person_hash").alias("_hash"))
    left = people.join(losers, people["id"] == losers["loser"], "left_anti").join(new, people["id"] == new["_id"], "left")
    return left.withColumn("person_hash", F.coalesce("_hash", "person_hash")).select(*people.columns), kept, audit


def upsert_metadata(old: DataFrame, incoming: DataFrame, keys: list[str], metadata: str) -> DataFrame:
    """W-11: rows with JSON ``metadata`` and ``action``: an update happens only if the object is another one.

    Objects compare by content: the order of their keys and white space do not count.
    """
    same = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))))
    differs = lambda o, n: ~same(o[metadata]).eqNullSafe(same(n[metadata]))
    return upsert(old, incoming, keys, guard=differs)


def coverage_history(history: DataFrame, today: DataFrame, keys: list[str], date: str, days: int = 365) -> DataFrame:
    """Q-28: ``history`` after the day's snapshot: one row for each day and key, those older than ``days`` gone.

    A second snapshot of a day replaces the first.
    """
    after = upsert(history, today, [date, *keys]).drop("action")
    last = today.agg(F.max(date).alias("_last"))
    return after.crossJoin(F.broadcast(last)).where(F.col(date) >= F.date_sub(F.col("_last"), days)).drop("_last")  # one row


def latest_days(history: DataFrame, date: str, n: int) -> DataFrame:
    """Q-28: the ``n`` latest days, oldest first."""
    return history.orderBy(F.desc(date)).limit(n).orderBy(date)

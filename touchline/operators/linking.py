"""Linking the null keys of many tables in one run (ER-04, ER-08), with aliases that warm up.

A name found by the fuzzy pass becomes an alias, so names that come later may be
found by it in the first pass. What a run of one name after the other would give is
computed without one: the fuzzy result depends on a name's query (its short form)
alone, so an alias is the query itself and only *since when* it is known depends on
the order. That time is the first appearance of a name with this query which finds
nothing before the fuzzy pass; whether an earlier alias catches it depends only on
the times of shorter forms, so a few rounds, one for each step of names that are
another name's short form, settle all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.similarity import unsafe_subset
from .fuzzy import set_ratio_hits
from .joins import union_all
from .lineage import cut
from .upsert import upsert

#: Of the aliases that the linker writes (fixed value).
SOURCE = "linker-fuzzy"


class Target:
    """A table whose null ``fk`` is to be found by the name in ``raw``; ``key`` is unique and gives the order."""

    def __init__(self, name: str, frame: DataFrame, key: str, raw: str, fk: str):
        self.name, self.frame, self.key, self.raw, self.fk = name, frame, key, raw, fk


def _index(df: DataFrame, key: str, value: str) -> DataFrame:
    """The greatest id of each lower-case trimmed name."""
    return df.where(F.col(value).isNotNull() & (F.trim(key) != "")).groupBy(F.lower(F.trim(key)).alias("_key")).agg(F.max(value).cast("long").alias("_id"))


def _looked_up(df: DataFrame, index: DataFrame, key: str, out: str) -> DataFrame:
    side = index.select(F.col("_key").alias(f"_k{out}"), F.col("_id").alias(out))
    return df.join(side, df[key] == side[f"_k{out}"], "left").drop(f"_k{out}")


def open_rows(targets: list[Target], ignored: DataFrame | None = None) -> DataFrame:
    """``target, id, raw, at, ignored`` of all rows to link; ``at`` orders them: by target, then key."""
    parts = []
    for i, t in enumerate(targets):
        rows = t.frame.where(F.col(t.fk).isNull() & F.col(t.raw).isNotNull() & (F.col(t.raw) != ""))
        parts.append(rows.select(F.lit(t.name).alias("target"), F.col(t.key).cast("long").alias("id"), F.col(t.raw).alias("raw"), F.struct(F.lit(i).alias("t"), F.col(t.key).cast("long").alias("id")).alias("at")))
    rows = union_all(parts)
    if ignored is None:
        return rows.withColumn("ignored", F.lit(False))
    skip = ignored.select(F.lower("raw_team_name").alias("_skip")).where("_skip IS NOT NULL").distinct()
    return rows.join(skip, F.lower(rows["raw"]) == skip["_skip"], "left").withColumn("ignored", F.col("_skip").isNotNull()).drop("_skip")


def _known_names(rows: DataFrame, canonicals: DataFrame, aliases: DataFrame, least: float) -> DataFrame:
    """Each different name with its forms, what the passes find for it, and its first appearance."""
    one = rows.where("NOT ignored").groupBy("raw").agg(F.min("at").alias("first"))
    short = F.nullif(F.lower(names.without_team_words(F.col("raw"))), F.lit(""))
    one = one.select("raw", "first", F.nullif(F.lower(F.trim("raw")), F.lit("")).alias("own"), short.alias("short")).withColumn("query", F.coalesce("short", "own"))
    by_alias, by_name = _index(aliases, "alias", "club_id"), _index(canonicals, "name", "id")
    for key in ("own", "short"):
        one = _looked_up(_looked_up(one, by_alias, key, f"alias_{key}"), by_name, key, f"name_{key}")
    one = cut(one)
    missed = one.where("coalesce(alias_own, alias_short, name_own, name_short) IS NULL AND query IS NOT NULL").select(F.lit("").alias("_scope"), F.col("query").alias("raw"), F.col("query").alias("_query")).distinct()
    choices = by_name.unionByName(by_alias).select(F.lit("").alias("_scope"), F.col("_key").alias("choice"), F.col("_id").alias("choice_id")).distinct()
    scored = set_ratio_hits(missed, choices, least).where(~unsafe_subset(F.col("_query"), F.col("choice")))
    best = scored.groupBy("_query").agg(F.min_by(F.struct("choice_id", "score"), F.struct(-F.col("score"), F.col("choice"), F.col("choice_id"))).alias("best"))
    return cut(one.join(best, one["query"] == best["_query"], "left").select(*one.columns, F.col("best.choice_id").alias("fuzzy"), F.col("best.score").alias("score")))


def warm_aliases(known: DataFrame) -> DataFrame:
    """``_key, _id, since``: the aliases that the run adds, and the row that adds each.

    A name adds its query when it misses all exact passes, the fuzzy one finds it, and
    no alias added before catches its own form.
    """
    may = known.where("coalesce(alias_own, alias_short, name_own, name_short) IS NULL AND fuzzy IS NOT NULL")
    keys = may.select(F.col("query").alias("_other")).distinct()
    same = may.where("own = query")
    apart = may.where("own <> query").join(keys, F.col("own") == F.col("_other"), "left")
    free = same.unionByName(apart.where("_other IS NULL").drop("_other"))
    waiting = cut(apart.where("_other IS NOT NULL").select("raw", "own", "query", "first", "fuzzy"))  # their own form may be added by others
    earliest = lambda df: df.groupBy(F.col("query").alias("_key")).agg(F.min("first").alias("since"), F.max("fuzzy").alias("_id"))
    base = cut(free.select("query", "first", "fuzzy"))
    now, passed = cut(earliest(base)), None
    while not waiting.isEmpty():
        side = now.select(F.col("_key").alias("_k"), "since")
        through = cut(waiting.join(side, waiting["own"] == side["_k"], "left").where("since IS NULL OR first < since").select("raw", "query", "first", "fuzzy"))
        if passed is not None and through.select("raw").exceptAll(passed).isEmpty() and passed.exceptAll(through.select("raw")).isEmpty():
            break
        passed = through.select("raw")
        now = cut(earliest(base.unionByName(through.select("query", "first", "fuzzy"))))
    return now


def resolve(rows: DataFrame, canonicals: DataFrame, aliases: DataFrame, least: float = 88) -> tuple[DataFrame, DataFrame]:
    """``target, id, raw, club_id, pass, score`` of ``open_rows``, and the aliases added (``club_id, alias``).

    ``canonicals (id, name)``, ``aliases (club_id, alias)``; of equal keys the greatest id.
    Passes: 1 alias, 2 canonical name (own form before short form), 3 fuzzy, 4 none;
    ignored rows have pass 0.
    """
    rows = cut(rows)
    known = _known_names(rows, canonicals, aliases, least)
    warm = warm_aliases(known)
    timed = known
    for key in ("own", "short"):
        side = warm.select(F.col("_key").alias("_k"), F.struct("_id", "since").alias(f"warm_{key}"))
        timed = timed.join(side, timed[key] == side["_k"], "left").drop("_k")
    out = rows.join(timed.drop("first"), "raw", "left")
    added = lambda key: F.when(F.col(f"warm_{key}.since") < F.col("at"), F.col(f"warm_{key}._id"))
    first: Column = F.coalesce("alias_own", added("own"), "alias_short", added("short"))
    second = F.coalesce("name_own", "name_short")
    number = F.when(F.col("ignored"), 0).when(first.isNotNull(), 1).when(second.isNotNull(), 2).when(F.col("fuzzy").isNotNull(), 3).otherwise(4)
    found = out.select("target", "id", "raw", F.when(~F.col("ignored"), F.coalesce(first, second, F.col("fuzzy"))).alias("club_id"), number.alias("pass"), F.when(number == 3, F.floor("score").cast("int")).alias("score"))
    return cut(found), warm.select(F.col("_id").alias("club_id"), F.col("_key").alias("alias"))


def link_all(targets: list[Target], canonicals: DataFrame, aliases: DataFrame, ignored: DataFrame | None = None, least: float = 88) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Every target with its null keys filled; the rows' results; the aliases after the run.

    ``aliases`` may have ``source``; what the fuzzy pass found is upserted with
    ``linker-fuzzy``. Keys that are set stay; rows without a name, ignored and unmatched
    rows keep their null.
    """
    found, added = resolve(open_rows(targets, ignored), canonicals, aliases, least)
    linked = {}
    for t in targets:
        mine = found.where((F.col("target") == t.name) & F.col("club_id").isNotNull()).select(F.col("id").alias("_lid"), F.col("club_id").alias("_lclub"))
        joined = t.frame.join(mine, t.frame[t.key].cast("long") == mine["_lid"], "left")
        linked[t.name] = joined.withColumn(t.fk, F.coalesce(F.col(t.fk), F.col("_lclub").cast(t.frame.schema[t.fk].dataType))).select(*t.frame.columns)
    return linked, found, promote(aliases, added)


def promote(aliases: DataFrame, added: DataFrame, source: str = SOURCE) -> DataFrame:
    """W-12: aliases with those added (``club_id, alias``); a known one takes the new ``source``, an equal row is left alone.

    Returns ``aliases`` with ``source`` and ``action`` (inserted, updated, unchanged, kept).
    """
    old = aliases if "source" in aliases.columns else aliases.withColumn("source", F.lit(None).cast("string"))
    return upsert(old.select("club_id", "alias", "source"), added.select(F.col("club_id").cast(old.schema["club_id"].dataType).alias("club_id"), "alias", F.lit(source).alias("source")).distinct(), ["club_id", "alias"])


def linker_stats(found: DataFrame) -> DataFrame:
    """``target, linked, pass_1, pass_2, pass_3, no_match, ignored`` of the results."""
    n = lambda p: F.count_if(F.col("pass") == p)
    return found.groupBy("target").agg(F.count("club_id").alias("linked"), *(n(k).alias(f"pass_{k}") for k in (1, 2, 3)), n(4).alias("no_match"), n(0).alias("ignored"))


def unmatched(found: DataFrame, least: int = 1) -> DataFrame:
    """Names that nothing was found for, by short form (the trimmed name where that is blank), with their rows, most first."""
    bucket = F.coalesce(F.nullif(names.without_team_words(F.col("raw")), F.lit("")), F.trim("raw"))
    return found.where("pass = 4").groupBy(bucket.alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "name")

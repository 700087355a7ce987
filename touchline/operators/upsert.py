"""Keyed upserts (W-*): pure forms ``new_state = f(old, incoming)``.

Keys compare null-safe. Incoming rows with the same key are reduced to the last
one by ``order`` where that is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import keep_last

Policy = Callable[[Column, Column, Column, Column], Column]


def overwrite(old: Column, new: Column, o: Column, n: Column) -> Column:
    """W-01."""
    return new


def new_wins(old: Column, new: Column, o: Column, n: Column) -> Column:
    """W-02: new values that are not null."""
    return F.coalesce(new, old)


def fill_only(old: Column, new: Column, o: Column, n: Column) -> Column:
    """W-03."""
    return F.coalesce(old, new)


def by_confidence(confidence: str) -> Policy:
    """W-09: a new value wins with at least the stored confidence; else it only fills."""

    def policy(old: Column, new: Column, o: Column, n: Column) -> Column:
        sure = o[confidence].isNull() | (n[confidence] >= o[confidence])
        return F.when(new.isNotNull() & sure, new).otherwise(F.coalesce(old, new))

    return policy


def upsert(old: DataFrame, incoming: DataFrame, keys: list[str], policy: Policy | dict[str, Policy] = overwrite, guard: Callable[[Column, Column], Column] | None = None, order: list[Column] | None = None) -> DataFrame:
    """All rows after the upsert, with ``action``: inserted, updated, unchanged or kept.

    ``policy`` is one for all columns or one for each; ``guard(old, new)`` must
    hold for an update (W-10). A row that comes out as it was is unchanged (W-04).
    """
    if order:
        incoming = keep_last(incoming, [F.col(k) for k in keys], order)
    values = [c for c in old.columns if c not in keys]
    o = old.select(*(F.col(k).alias(f"_ok{i}") for i, k in enumerate(keys)), F.struct(*values).alias("_o"), F.lit(True).alias("_in_old"))
    n = incoming.select(*(F.col(k).alias(f"_nk{i}") for i, k in enumerate(keys)), F.struct(*values).alias("_n"), F.lit(True).alias("_in_new"))
    on = [o[f"_ok{i}"].eqNullSafe(n[f"_nk{i}"]) for i in range(len(keys))]
    both = o.join(n, on, "full")
    in_old, in_new = F.col("_in_old").isNotNull(), F.col("_in_new").isNotNull()
    meets = in_old & in_new if guard is None else in_old & in_new & F.coalesce(guard(F.col("_o"), F.col("_n")), F.lit(False))
    result = {}
    for c in values:
        p = policy.get(c, overwrite) if isinstance(policy, dict) else policy
        merged = p(F.col(f"_o.{c}"), F.col(f"_n.{c}"), F.col("_o"), F.col("_n"))
        result[c] = F.when(meets, merged).when(in_old, F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}"))
    changed = F.lit(False)
    for c in values:
        changed = changed | ~result[c].eqNullSafe(F.col(f"_o.{c}"))
    action = F.when(~in_old, "inserted").when(~in_new, "kept").when(meets & changed, "updated").otherwise("unchanged")
    key_columns = [F.when(in_old, F.col(f"_ok{i}")).otherwise(F.col(f"_nk{i}")).alias(k) for i, k in enumerate(keys)]
    return both.select(*key_columns, *(result[c].alias(c) for c in values), action.alias("action")).select(*old.columns, "action")


def insert_ignore(old: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """W-05: rows with a known key are ignored; the first of several new ones stays."""
    fresh = incoming.dropDuplicates(keys)
    taken = old.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    fresh = fresh.join(taken, [fresh[k].eqNullSafe(taken[f"_{k}"]) for k in keys], "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def upsert_by_platform_id(old: DataFrame, incoming: DataFrame, platform_id: str, natural: dict[str, object], policy: Policy = new_wins) -> DataFrame:
    """W-07, W-08, ST-02: by platform id where there is one, else by the natural key with sentinels.

    An incoming id is first given to the row without one that has the same natural
    key, so that an id that comes late finds its row.
    """
    keys = list(natural)
    with_key = lambda df, p: df.withColumns({f"{p}{k}": F.coalesce(F.col(k), F.lit(v)) if v is not None else F.col(k) for k, v in natural.items()})
    ids = with_key(incoming.where(F.col(platform_id).isNotNull()), "_n_").groupBy(*(f"_n_{k}" for k in keys)).agg(F.min(platform_id).alias("_pid"))
    known = old.where(F.col(platform_id).isNotNull()).select(F.col(platform_id).alias("_pid")).distinct()
    ids = ids.join(known, "_pid", "left_anti")
    open_rows = with_key(old.where(F.col(platform_id).isNull()), "_o_")
    swept = open_rows.join(ids, [open_rows[f"_o_{k}"].eqNullSafe(ids[f"_n_{k}"]) for k in keys], "left")
    swept = swept.withColumn(platform_id, F.col("_pid")).select(*old.columns)
    state = old.where(F.col(platform_id).isNotNull()).unionByName(swept)
    first = upsert(state.where(F.col(platform_id).isNotNull()), incoming.where(F.col(platform_id).isNotNull()), [platform_id], policy)
    marked = lambda df: with_key(df.where(F.col(platform_id).isNull()), "_k_")
    second = upsert(marked(state), marked(incoming), [f"_k_{k}" for k in keys], policy).select(*old.columns, "action")
    return first.unionByName(second)


def fill_from(df: DataFrame, column: str, key: str, lookup: DataFrame, lookup_key: str, value: str) -> DataFrame:
    """W-13: a null column takes the value of the row with the same key."""
    side = lookup.groupBy(F.col(lookup_key).alias("_k")).agg(F.min(value).alias("_v"))
    return df.join(side, df[key] == side["_k"], "left").withColumn(column, F.coalesce(column, "_v")).drop("_k", "_v")


def mark_missing(df: DataFrame, keys: list[str], present: DataFrame, flag: str) -> DataFrame:
    """W-14: ``flag`` is false where no present row has the keys."""
    there = present.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct().withColumn("_there", F.lit(True))
    return df.join(there, [df[k].eqNullSafe(there[f"_{k}"]) for k in keys], "left").withColumn(flag, F.col(flag) & F.col("_there").isNotNull()).drop(*(f"_{k}" for k in keys), "_there")


def expire(df: DataFrame, time: str, status: str, as_of: str, to: str = "expired") -> DataFrame:
    """W-15."""
    return df.withColumn(status, F.when(F.col(time) < F.lit(as_of).cast("timestamp_ntz"), to).otherwise(F.col(status)))


def redirect(df: DataFrame, column: str, losers: DataFrame, unique: list[str] | None = None) -> DataFrame:
    """W-19, W-20: ids of ``losers (loser, winner)`` become their winners'.

    With ``unique`` (other columns of a unique key), a loser's row whose key the
    winner already has is removed first; null key parts never collide.
    """
    table = df.join(losers, df[column] == losers["loser"], "left")
    moved = table.withColumn(column, F.coalesce("winner", column))
    if not unique:
        return moved.select(*df.columns)
    own = df.join(losers, df[column] == losers["loser"], "left_anti").select(F.col(column).alias("_w"), *(F.col(u).alias(f"_{u}") for u in unique)).distinct()
    stay = moved.where("loser IS NULL")
    move = moved.where("loser IS NOT NULL")
    move = move.join(own, [move[column] == own["_w"], *(move[u] == own[f"_{u}"] for u in unique)], "left_anti")
    return stay.unionByName(move).select(*df.columns)

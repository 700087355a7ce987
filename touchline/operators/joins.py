"""Joins (J-*): equi joins that stand for theta joins, as-of, diff, polymorphic, semi flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def either_key(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """J-05: ``l.a = r.a OR (l.a IS NULL AND l.b = r.b)`` as two disjoint equi joins."""
    a, b = first, second
    by_id = left.where(F.col(a[0]).isNotNull()).join(right, left[a[0]] == right[a[1]])
    by_name = left.where(F.col(a[0]).isNull()).join(right, left[b[0]] == right[b[1]])
    return by_id.unionByName(by_name)


def _windows(text: Column, size: int) -> Column:
    """All substrings of a size."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, text: str, names: DataFrame, name: str, size: int = 3) -> DataFrame:
    """J-06: pairs where the text holds the name, any case, the name taken literally.

    Each different text is searched once. Both sides meet on a piece of ``size``
    characters (the name's first one), so that no pair is tried without it; shorter
    names meet on what they have, and only lengths that some name has are cut.
    """
    n = names.withColumn("_n", F.lower(F.col(name))).where(F.length("_n") > 0)
    n = n.withColumn("_len", F.least(F.length("_n"), F.lit(size))).withColumn("_piece", F.expr("substring(_n, 1, _len)"))
    lengths = sorted(r[0] for r in n.select("_len").distinct().collect())  # ``size`` numbers at most
    each = texts.select(F.lower(F.col(text)).alias("_t")).where("_t IS NOT NULL").distinct()  # the grouping also keeps ``lower`` out of the lambdas
    pieces = F.array_distinct(F.flatten(F.array(*(_windows(F.col("_t"), k) for k in lengths)))) if lengths else F.array().cast("array<string>")
    met = each.withColumn("_piece", F.explode(pieces)).join(n.select("_piece", "_n").distinct(), "_piece").where(F.contains("_t", "_n")).select("_t", "_n")
    return texts.join(met, F.lower(F.col(text)) == met["_t"]).join(n.drop("_piece", "_len"), "_n").drop("_t", "_n")


#: Members of a class in one block of ``expanded``.
BLOCK = 1000


def expanded(pairs: DataFrame, members: DataFrame, classes: list[str], key: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Pairs of rows ``a_key < b_key`` of paired classes: ``a_key, b_key``, both sides' ``columns`` and the pairs' other columns.

    ``pairs`` has ``a_c`` and ``b_c`` for each column ``c`` of ``classes``, each unordered pair
    once; a class with itself stands for the pairs within it. Members are dealt into
    blocks of about ``block``, and blocks meet blocks, so that a large class is shared
    out among tasks and none holds it.
    """
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = [f"_k{i}" for i in range(len(classes))]
    m = members.select(*(F.col(c).alias(t) for c, t in zip(classes, told, strict=True)), F.col(key).alias("_key"), *(F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)))
    sizes = m.groupBy(*told).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    m = m.join(sizes, told).withColumn("_at", F.pmod(F.xxhash64("_key"), F.col("_blocks")).cast("int")).drop("_blocks")
    side = lambda df, s, *more: df.select(*(F.col(t).alias(f"{s}{t}") for t in told), *(F.col(c).alias(f"{s}{c}") for c in more))
    others = [c for c in pairs.columns if c not in {f"{s}_{c}" for s in "ab" for c in classes}]
    p = pairs.select(*(F.col(f"{s}_{c}").alias(f"{s}{t}") for s in "ab" for c, t in zip(classes, told, strict=True)), *others)
    keys = {s: [f"{s}{t}" for t in told] for s in "ab"}
    for s in "ab":
        p = p.join(side(sizes, s, "_blocks"), keys[s])
    same = reduce(lambda x, y: x & y, (F.col(f"a{t}") == F.col(f"b{t}") for t in told))
    p = p.withColumn("_same", same).withColumn("a_at", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1)))
    p = p.withColumn("b_at", F.explode(F.sequence(F.when(F.col("_same"), F.col("a_at")).otherwise(0), F.col("b_blocks") - 1))).drop("a_blocks", "b_blocks")
    for s in "ab":
        on = [*keys[s], f"{s}_at"]
        values = [f"_v{i}" for i in range(len(columns))]
        # Of a set number of parts, else small blocks would be merged into few tasks although their pairs are many.
        p = p.repartition(parts, *on).join(side(m, s, "_at", "_key", *values).repartition(parts, *on).hint("merge"), on)
    p = p.where(F.when(F.col("_same") & (F.col("a_at") == F.col("b_at")), F.col("a_key") < F.col("b_key")).otherwise(F.col("a_key") != F.col("b_key")))
    turned = F.col("a_key") > F.col("b_key")
    ordered = lambda c: (F.when(turned, F.col(f"b{c}")).otherwise(F.col(f"a{c}")), F.when(turned, F.col(f"a{c}")).otherwise(F.col(f"b{c}")))
    both = [("_key", key), *((t, c) for t, c in zip(told, classes, strict=True)), *((f"_v{i}", c) for i, c in enumerate(columns))]
    return p.select(*(x.alias(f"{s}_{c}") for inner, c in both for s, x in zip("ab", ordered(inner), strict=True)), *others)


def pairs_within(df: DataFrame, key: str, block: list[Column], columns: list[str]) -> DataFrame:
    """J-07, J-08: pairs ``a < b`` of rows with the same block key."""
    keys = [f"_b{i}" for i in range(len(block))]
    named = df.withColumns(dict(zip(keys, block, strict=True)))
    shared = named.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    pairs = shared.select(*(F.col(k).alias(f"{s}_{k}") for s in "ab" for k in keys))
    return expanded(pairs, named, keys, key, columns).drop(*(f"{s}_{k}" for s in "ab" for k in keys))


def with_flags(df: DataFrame, flags: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """J-09: a boolean column for each ``name: (other, key here, key there)``."""
    for name, (other, here, there) in flags.items():
        keys = other.select(F.col(there).alias(f"_{name}")).where(f"_{name} IS NOT NULL").distinct()
        df = df.join(keys, df[here] == keys[f"_{name}"], "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")
    return df


def polymorphic_name(df: DataFrame, kind: str, key: str, tables: dict[str, tuple[DataFrame, str, str]], out: str = "entity_name") -> DataFrame:
    """J-11: the name of ``(kind, key)`` from the table of its kind."""
    found = []
    for i, (value, (table, id_column, name)) in enumerate(tables.items()):
        side = table.select(F.col(id_column).alias(f"_id{i}"), F.col(name).alias(f"_name{i}"))
        df = df.join(side, (df[kind] == value) & (df[key] == side[f"_id{i}"]), "left").drop(f"_id{i}")
        found.append(f"_name{i}")
    return df.withColumn(out, F.coalesce(*found)).drop(*found)


def missing_periods(entities: DataFrame, key: str, periods: list, existing: DataFrame, existing_key: str, period: str) -> DataFrame:
    """J-10, J-13: entities × a short list of periods, without what exists."""
    every = entities.select(key).distinct().withColumn(period, F.explode(F.array(*(F.lit(p) for p in periods))))
    have = existing.select(F.col(existing_key).alias("_k"), F.col(period).alias("_p")).distinct()
    return every.join(have, (every[key] == have["_k"]) & (every[period] == have["_p"]), "left_anti")


def previous_snapshot(df: DataFrame, group: list[str], at: str) -> DataFrame:
    """J-17: every snapshot date of a group with the one before it (null for the first)."""
    dates = df.select(*group, at).distinct()
    return dates.withColumn("previous", F.lag(at).over(Window.partitionBy(*group).orderBy(at)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """The row of ``right`` with the greatest time not after the left row's, by union and window."""
    payload = F.struct(*columns)
    l_ = left.withColumn("_id", F.monotonically_increasing_id())
    both = l_.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), "_id", F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_p")).unionByName(
        right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_id"), payload.alias("_p"))
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_last", F.last("_p", ignorenulls=True).over(w)).where("_side = 1").select("_id", "_last")
    return l_.join(got, "_id").select(*left.columns, *(F.col(f"_last.{c}").alias(c if c not in left.columns else f"right_{c}") for c in columns))


def first_of_two_keys(df: DataFrame, keys: list[str], index: DataFrame, index_key: str, value: str, out: str) -> DataFrame:
    """J-19: the index's value for the first of several keys that it has."""
    found = []
    for i, key in enumerate(keys):
        side = index.select(F.col(index_key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        df = df.join(side, df[key] == side[f"_k{i}"], "left").drop(f"_k{i}")
        found.append(f"_v{i}")
    return df.withColumn(out, F.coalesce(*found)).drop(*found)


def neighbours(edges: DataFrame, node: str, group: str, start) -> DataFrame:
    """J-22: other nodes in any group of the start node."""
    mine = edges.where(F.col(node) == start).select(group).distinct()
    return edges.join(mine, group, "left_semi").where(F.col(node) != start).select(node).distinct()


def name_map(df: DataFrame, name: Column, key: str) -> DataFrame:
    """J-24: ``name, id, ambiguous``."""
    return df.groupBy(name.alias("name")).agg(F.min(key).alias("id"), (F.countDistinct(key) > 1).alias("ambiguous"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """U-02."""
    return reduce(DataFrame.unionByName, frames)

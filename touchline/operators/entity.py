"""Entity resolution (ER-*): pairs, tiers, linker, greedy dedup, merges, rebuckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, similarity
from ..functions.classify import match_class, person_hash
from . import fuzzy
from .aggregates import completeness, keep_last
from .fuzzy import indel_candidates, set_ratio_hits
from .lineage import cut
from .joins import expanded, first_of_two_keys
from .upsert import redirect

#: Score from which names are the same (fixed value).
SAME = 88


def normalize(df: DataFrame, name: str) -> DataFrame:
    """ER-01: valid names only, with ``canonical_name``."""
    return df.where(names.is_valid_name(F.col(name))).withColumn("canonical_name", names.canonical_name(F.col(name)))


def _token_pairs(texts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Pairs ``a_text < b_text`` of a block (``keys``) whose token sets can have a Jaccard share of ``share``.

    Two such sets share one of the first ``n - ceil(share * n) + 1`` tokens of each in
    one order, rarest first, so a frequent token joins only names that have nothing
    rarer. Names without tokens are alike and meet on a token of their own.
    """
    named = texts.withColumn("_set", F.array_distinct("_tok"))
    often = named.select(F.explode("_set").alias("_t")).groupBy("_t").agg(F.count("*").alias("_df"))
    one = named.select("text", *keys, F.size("_set").alias("_n"), F.explode("_set").alias("_t")).join(often, "_t")
    first = F.array_sort(F.collect_list(F.struct("_df", "_t")))
    ranked = one.groupBy("text", *keys, "_n").agg(first.alias("_all"))
    most = F.col("_n") - F.ceil(F.lit(share) * F.col("_n") - 1e-9).cast("int") + 1
    heads = ranked.select("text", *keys, F.explode(F.transform(F.slice("_all", F.lit(1), most), lambda x: x["_t"])).alias("_t"))
    heads = heads.unionByName(named.where(F.size("_set") == 0).select("text", *keys, F.lit("").alias("_t")))
    side = lambda s: heads.select(F.col("text").alias(f"{s}_text"), *keys, "_t")
    met = side("a").join(side("b"), [*keys, "_t"]).where("a_text < b_text").select(*keys, "a_text", "b_text").distinct()
    full = lambda s: texts.select(*keys, F.col("text").alias(f"{s}_text"), F.col("_tok").alias(f"{s}_tok"))
    return met.join(full("a"), [*keys, "a_text"]).join(full("b"), [*keys, "b_text"])


def duplicate_pairs(df: DataFrame, key: str, name: str, block: list[Column], least: float, skip_extensions: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    """ER-09, ER-10: pairs within a block with combined similarity of ``least`` or more: keys, names, ``columns`` of both rows, ``similarity``.

    Different names of a block are compared once; their rows, and those with the same
    name, are paired by ``joins.expanded``.
    """
    keys = [f"_b{i}" for i in range(len(block))]
    members = df.withColumns(dict(zip(keys, block, strict=True)))
    texts = members.select(*keys, F.col(name).alias("text")).dropna().distinct()
    tokened = texts.withColumn("_tok", names.tokens(F.col("text")))
    if least > 0.4:
        pairs = _token_pairs(tokened, keys, (least - 0.4) / 0.6)
    else:
        side = lambda s: tokened.select(*keys, F.col("text").alias(f"{s}_text"), F.col("_tok").alias(f"{s}_tok"))
        pairs = side("a").join(side("b"), keys).where("a_text < b_text")
    a, b = F.col("a_text"), F.col("b_text")
    if skip_extensions:
        pairs = pairs.where(~names.is_extension(a, b))
    # Cheap bound first: token share alone decides most pairs.
    jaccard = similarity.token_jaccard(F.col("a_tok"), F.col("b_tok"))
    pairs = pairs.withColumn("_j", jaccard).where(0.4 + 0.6 * F.col("_j") >= least)
    score = 0.4 * similarity.edit_similarity(F.lower(a), F.lower(b)) + 0.6 * F.col("_j")
    pairs = pairs.withColumn("similarity", score).where(F.col("similarity") >= least).select(*keys, "a_text", "b_text", "similarity")
    if least <= 1:
        pairs = pairs.unionByName(texts.select(*keys, F.col("text").alias("a_text"), F.col("text").alias("b_text"), F.lit(1.0).alias("similarity")))
    classes = pairs.select(*(F.col(k).alias(f"{s}_{k}") for s in "ab" for k in keys), a.alias(f"a_{name}"), b.alias(f"b_{name}"), "similarity")
    return expanded(cut(classes), members, [*keys, name], key, list(columns)).drop(*(f"{s}_{k}" for s in "ab" for k in keys))


#: What a row brings to its pairs' tiers.
TIER_COLUMNS = ("_here", "_state", "_site", "_merged", "_complete", "_words")


def tier_columns(meta: DataFrame) -> DataFrame:
    """``meta`` (``name, state, website, manually_merged, completeness``) with ``TIER_COLUMNS``."""
    return meta.withColumns({
        "_here": F.lit(True), "_state": F.nullif(F.upper(F.trim("state")), F.lit("")), "_site": names.website(F.col("website")), "_merged": F.coalesce("manually_merged", F.lit(False)),
        "_complete": F.col("completeness"), "_words": F.array_distinct(F.split(F.lower(F.trim("name")), r"\s+")),
    })


def tier_pairs(pairs: DataFrame, meta: DataFrame, key: str, least: float = 0.95) -> DataFrame:
    """ER-11, ER-12: skip, review or auto_merge with a reason and the winner.

    ``meta`` has ``key, name, state, website, manually_merged, completeness``.
    """
    m = tier_columns(meta)
    side = lambda s: m.select(F.col(key).alias(f"{s}_{key}"), *(F.col(c).alias(f"{s}_{c}") for c in TIER_COLUMNS))
    return tiers(pairs.join(side("a"), f"a_{key}", "left").join(side("b"), f"b_{key}", "left"), key, least).select(*pairs.columns, "tier", "reason", "winner")


def tiers(pairs: DataFrame, key: str, least: float = 0.95) -> DataFrame:
    """ER-11, ER-12 of pairs that bring ``TIER_COLUMNS`` of both rows."""
    same_state = F.coalesce(F.col("a__state") == F.col("b__state"), F.lit(False))
    n, m = F.size("a__words"), F.size("b__words")
    small, large = F.least(n, m), F.greatest(n, m)
    inside = (small <= 1) & (large > small) & (F.size(F.array_intersect("a__words", "b__words")) == small)
    rules = [
        (F.col("a__here").isNull() | F.col("b__here").isNull(), "skip", "missing row"),
        (F.col("a__merged") | F.col("b__merged"), "skip", "manually merged"),
        (F.coalesce(F.col("a__site") != F.col("b__site"), F.lit(False)), "review", "websites differ"),
        (~same_state, "review", "state mismatch"),
        (inside, "review", "short name"),
        (F.col("similarity") < least, "review", "similarity"),
    ]
    tier = reason = None
    for hit, t, why in rules:
        tier = F.when(hit, t) if tier is None else tier.when(hit, t)
        reason = F.when(hit, why) if reason is None else reason.when(hit, why)
    a_wins = (F.col("a__complete") > F.col("b__complete")) | ((F.col("a__complete") == F.col("b__complete")) & (F.col(f"a_{key}") < F.col(f"b_{key}")))
    out = pairs.withColumn("tier", tier.otherwise("auto_merge")).withColumn("reason", reason.otherwise("same"))
    return out.withColumn("winner", F.when(F.col("tier") == "auto_merge", F.when(a_wins, F.col(f"a_{key}")).otherwise(F.col(f"b_{key}"))))


def _in_order(name: str) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")), " ")


def _greedily_gone(alike: DataFrame) -> DataFrame:
    """``v`` of pairs ``a`` before ``b``: those alike to an earlier one that stays.

    Rows without an undecided earlier partner stay, their later partners go, until all
    are decided. Each round is written to checkpoint storage.
    """
    left = cut(alike)
    gone = left.select(F.col("b").alias("v")).limit(0)
    while not left.isEmpty():
        # Rows that are nobody's later partner any more stay.
        stay = left.select(F.col("a").alias("v")).distinct().join(left.select(F.col("b").alias("v")).distinct(), "v", "left_anti")
        now = cut(left.join(stay, left.a == stay.v, "left_semi").select(F.col("b").alias("v")).distinct())
        gone = gone.unionByName(now)
        left = left.join(now.withColumnRenamed("v", "_x"), left.a == F.col("_x"), "left_anti").join(now.withColumnRenamed("v", "_y"), left.b == F.col("_y"), "left_anti")
        left = cut(left.join(stay.withColumnRenamed("v", "_z"), left.a == F.col("_z"), "left_anti"))
    return gone


def greedy_dedup(df: DataFrame, order: str, name: str, least: float = SAME) -> DataFrame:
    """ER-02: a row goes if an earlier row that stays is alike; ``order`` is unique.

    Equal names fall to their first row at once; the others are decided over the pairs
    that are alike.
    """
    firsts = keep_last(df, [F.col(name)], [F.col(order).asc()])
    pairs = indel_candidates(firsts.withColumn("_s", _in_order(name)), order, "_s", least)
    text = firsts.select(F.col(order).alias("_o"), F.col(name).alias("_n"))
    scored = pairs.join(text.withColumnsRenamed({"_o": "a", "_n": "na"}), "a").join(text.withColumnsRenamed({"_o": "b", "_n": "nb"}), "b")
    gone = _greedily_gone(scored.where(similarity.token_sort_ratio(F.col("na"), F.col("nb")) >= least).select("a", "b"))
    return firsts.join(gone.withColumnRenamed("v", "_v"), firsts[order] == F.col("_v"), "left_anti")


def master_index(master: DataFrame, order: str, name: str, least: float = SAME) -> DataFrame:
    """ER-03: the pieces of a master's names, to be stored beside it for ``append_to_master``."""
    return fuzzy.piece_index(master.withColumn("_s", _in_order(name)), order, "_s", least)


def append_to_master(master: DataFrame, index: DataFrame, new: DataFrame, keys: list[str], order: str, name: str, least: float = SAME) -> tuple[DataFrame, DataFrame]:
    """ER-03: the master and its index after ``new`` rows, as dedup of the whole frame would give.

    ``master`` holds rows that stay (no two alike); ``order`` is unique and later in
    ``new``. The last row of each key stays, so a new one replaces its like at its later
    place. Rows of the master cannot go otherwise: only new rows probe the index and
    each other, and only their pieces are added to it. (Blank names have no pieces; they
    are alike by equality.)
    """
    fresh = keep_last(new, [F.col(k) for k in keys], [F.col(order).desc()])
    taken = fresh.select(*(F.col(k).alias(f"_{k}") for k in keys))
    stays = cut(master.join(taken, [master[k].eqNullSafe(taken[f"_{k}"]) for k in keys], "left_anti"))
    fresh = cut(keep_last(fresh, [F.col(name)], [F.col(order).asc()]).withColumn("_s", _in_order(name)))
    side = lambda df, s: df.select(F.col(order).alias(f"_o{s}"), F.col(name).alias(f"_n{s}"))
    same = fresh.join(stays.select(F.col(name).alias("_same")).distinct(), F.col(name).eqNullSafe(F.col("_same")), "left_semi").select(order)
    met = fuzzy.probe_pieces(index, fresh, order, "_s", least)
    scored = met.join(side(stays, 1), F.col("_k") == F.col("_o1")).join(side(fresh, 2), F.col("_k2") == F.col("_o2")).where(similarity.token_sort_ratio(F.col("_n1"), F.col("_n2")) >= least)
    lost = cut(scored.select(F.col("_k2").alias("_lost")).unionByName(same.select(F.col(order).alias("_lost"))).distinct())
    left = cut(fresh.join(lost, fresh[order] == lost["_lost"], "left_anti"))
    pairs = indel_candidates(left, order, "_s", least)
    within = pairs.join(side(left, 1), F.col("a") == F.col("_o1")).join(side(left, 2), F.col("b") == F.col("_o2")).where(similarity.token_sort_ratio(F.col("_n1"), F.col("_n2")) >= least).select("a", "b")
    gone = _greedily_gone(within)
    kept = cut(left.join(gone.withColumnRenamed("v", "_v"), left[order] == F.col("_v"), "left_anti"))
    return stays.unionByName(kept.drop("_s"), allowMissingColumns=True), index.unionByName(fuzzy.piece_index(kept, order, "_s", least))


def link_names(raw: DataFrame, column: str, canonicals: DataFrame, aliases: DataFrame, least: float = SAME) -> DataFrame:
    """ER-04, ER-05, ER-08: each different raw name with ``club_id`` and the pass that found it.

    ``canonicals (id, name)`` and ``aliases (club_id, alias)``; of equal keys the
    greatest id is used. Passes: alias exact, canonical exact (raw before stripped
    form), fuzzy among choices that share a token, none. Deterministic: names
    resolve on their own, and found ones do not change later ones.
    """
    # Cut, as filters on the forms of a name would else go below the grouping, to every row.
    distinct = cut(raw.select(F.col(column).alias("raw")).where(F.trim("raw") != "").distinct())
    distinct = distinct.withColumn("_raw", F.lower(F.trim("raw"))).withColumn("_short", F.nullif(F.lower(names.without_team_words(F.col("raw"))), F.lit("")))
    alias_index = cut(aliases.where("club_id IS NOT NULL").groupBy(F.lower(F.trim("alias")).alias("_key")).agg(F.max("club_id").alias("_id")))
    name_index = cut(canonicals.groupBy(F.lower(F.trim("name")).alias("_key")).agg(F.max("id").alias("_id")))
    found = first_of_two_keys(distinct, ["_raw", "_short"], alias_index, "_key", "_id", "_by_alias")
    found = cut(first_of_two_keys(found, ["_raw", "_short"], name_index, "_key", "_id", "_by_name"))
    rest = found.where("_by_alias IS NULL AND _by_name IS NULL").withColumn("_query", F.coalesce("_short", "_raw"))
    choices = name_index.unionByName(alias_index).select(F.lit("").alias("_scope"), F.col("_key").alias("choice"), F.col("_id").alias("choice_id")).distinct()
    scored = set_ratio_hits(rest.select(F.lit("").alias("_scope"), "raw", "_query"), choices, least)
    scored = scored.where(~similarity.unsafe_subset(F.col("_query"), F.col("choice")))
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("raw").orderBy(F.desc("score"), "choice", "choice_id"))).where("_r = 1").select(F.col("raw").alias("_fraw"), F.col("choice_id").alias("_by_fuzzy"), "score")
    out = found.join(best, found["raw"] == best["_fraw"], "left")
    number = F.when(F.col("_by_alias").isNotNull(), 1).when(F.col("_by_name").isNotNull(), 2).when(F.col("_by_fuzzy").isNotNull(), 3).otherwise(4)
    return out.select("raw", F.coalesce("_by_alias", "_by_name", "_by_fuzzy").alias("club_id"), number.alias("pass"), F.floor("score").cast("int").alias("score"))


def link_schools(raw: DataFrame, schools: DataFrame, aliases: DataFrame, least: float = SAME) -> DataFrame:
    """ER-07: each ``state, name`` of ``raw`` with ``id`` and the pass that found it, within its state.

    ``schools`` and ``aliases`` have ``id, state, name``; of equal keys the greatest
    id is used. Passes: alias exact, school exact (raw before normalised form),
    fuzzy, none. A row without state or name is never found.
    """
    state, key = F.upper(F.trim("state")).alias("_scope"), F.lower(F.trim("name")).alias("_key")
    q = cut(raw.select("state", "name").distinct()).select("state", "name", state, key, F.nullif(names.school_name(F.col("name")), F.lit("")).alias("_short"))
    index = lambda df: df.select(state, key, "id").where("_scope <> '' AND _key <> ''").groupBy("_scope", "_key").agg(F.max("id").alias("_id"))
    by_alias, by_name = index(aliases), index(schools)
    scoped = lambda scope, c: F.to_json(F.struct(F.col(scope).alias("s"), F.col(c).alias("k")), {"ignoreNullFields": "false"})
    q = q.withColumns({"_own_key": F.when(F.col("_key") != "", scoped("_scope", "_key")), "_short_key": F.when(F.col("_short").isNotNull(), scoped("_scope", "_short"))})
    found = q
    for side, out in ((by_alias, "_by_alias"), (by_name, "_by_name")):
        found = first_of_two_keys(found, ["_own_key", "_short_key"], side.select(scoped("_scope", "_key").alias("_key"), "_id"), "_key", "_id", out)
    rest = found.where("_by_alias IS NULL AND _by_name IS NULL AND _scope <> '' AND _key <> ''").select("_scope", F.col("_own_key").alias("raw"), F.coalesce("_short", "_key").alias("_query"))
    choices = by_name.unionByName(by_alias).select("_scope", F.col("_key").alias("choice"), F.col("_id").alias("choice_id")).distinct()
    scored = set_ratio_hits(rest.distinct(), choices, least)
    best = scored.groupBy("raw").agg(F.min_by("choice_id", F.struct(-F.col("score"), F.col("choice"), F.col("choice_id"))).alias("_by_fuzzy"), F.max("score").alias("score"))
    out = found.join(best, found["_own_key"] == best["raw"], "left")
    number = F.when(F.col("_by_alias").isNotNull(), 1).when(F.col("_by_name").isNotNull(), 2).when(F.col("_by_fuzzy").isNotNull(), 3).otherwise(4)
    return out.select("state", "name", F.coalesce("_by_alias", "_by_name", "_by_fuzzy").alias("id"), number.alias("pass"), F.when(number == 3, F.floor("score").cast("int")).alias("score"))


def resolve_chains(losers: DataFrame) -> DataFrame:
    """ER-13: ``loser, winner`` with winners that are nobody's losers (pointer doubling); a circle raises ValueError."""
    now = losers
    for _ in range(losers.count().bit_length() + 1):
        step = now.select(F.col("loser").alias("_l"), F.col("winner").alias("_w"))
        then = cut(now.join(step, now["winner"] == step["_l"], "left").select("loser", F.coalesce("_w", "winner").alias("winner"), F.col("_w").isNotNull().alias("moved")))
        now = then.drop("moved")
        if then.where("moved").isEmpty():
            return now
    raise ValueError("the merges run in a circle")


def merge(tables: dict[str, tuple[DataFrame, str, list[str] | None]], losers: DataFrame, clubs: DataFrame, key: str) -> dict[str, DataFrame]:
    """ER-13: every table re-pointed, losers deleted; manually merged clubs stay apart.

    ``tables``: name -> (frame, id column, other columns of its unique key).
    """
    guarded = clubs.where(F.coalesce("manually_merged", F.lit(False))).select(F.col(key).alias("loser"))
    final = resolve_chains(losers.join(guarded, "loser", "left_anti"))
    out = {name: redirect(frame, column, final, unique) for name, (frame, column, unique) in tables.items()}
    out["clubs"] = clubs.join(final, clubs[key] == final["loser"], "left_anti")
    return out


def merge_two(tables: dict[str, tuple[DataFrame, str]], clubs: DataFrame, key: str, winner: int, loser: int) -> dict[str, DataFrame]:
    """ER-14: one decided merge: tables re-pointed without a look at collisions, the winner marked, the loser gone.

    ValueError for ids that are not positive, equal, or missing in ``clubs``.
    """
    if min(winner, loser) <= 0 or winner == loser:
        raise ValueError("winner and loser must be two positive ids")
    if clubs.where(F.col(key).isin(winner, loser)).select(key).distinct().count() < 2:
        raise ValueError(f"{winner} or {loser} is no club")
    moved = {name: frame.withColumn(column, F.when(F.col(column) == loser, F.lit(winner).cast(frame.schema[column].dataType)).otherwise(F.col(column))) for name, (frame, column) in tables.items()}
    kept = clubs.where(F.col(key) != loser)
    return moved | {"clubs": kept.withColumn("manually_merged", F.col("manually_merged") | (F.col(key) == winner))}


def over_collapsed(aliases: DataFrame, club: str, alias: str, least_aliases: int = 3, least_roots: int = 2) -> DataFrame:
    """ER-15: clubs whose aliases have several different stripped roots."""
    root = F.nullif(F.lower(names.without_team_words(F.col(alias))), F.lit(""))
    return aliases.groupBy(club).agg(F.count("*").alias("n_aliases"), F.countDistinct(root).alias("n_roots")).where((F.col("n_aliases") >= least_aliases) & (F.col("n_roots") >= least_roots))


def rebucket(rows: DataFrame, column: str, raw: str, roots: DataFrame) -> DataFrame:
    """ER-16: rows move to the club of their name's root (``root, club_id``)."""
    keyed = rows.withColumn("_root", F.lower(names.without_team_words(F.col(raw))))
    side = roots.select(F.col("root").alias("_r"), F.col("club_id").alias("_c"))
    return keyed.join(side, keyed["_root"] == side["_r"], "left").withColumn(column, F.coalesce("_c", column)).select(*rows.columns)


def diff_with_master(external: DataFrame, master: DataFrame) -> DataFrame:
    """ER-17: external rows (``state, name``) with the best master name of their state, score and class.

    ``master`` has ``id, state, name``. Canonical names are compared, blank ones of
    the master left out; of equal scores the first master row (by ``id``) is taken.
    A name without any likeness, or in a state without masters, has none and score 0.
    """
    scope = lambda df: F.coalesce(F.upper(F.trim("state")), F.lit("")).alias("_scope")
    # Each different name is worked out once: without the cuts, filters on it would go below the grouping, to every row.
    e = cut(external.select("state", "name").distinct()).select("state", "name", scope(external), names.canonical_name(F.col("name")).alias("canonical_name"))
    e = cut(e)
    m = cut(master.groupBy("state", "name").agg(F.min("id").alias("rank"))).select(scope(master), names.canonical_name(F.col("name")).alias("choice"), "rank").where("choice <> ''")
    best = fuzzy.best_matches(e.select("_scope", F.col("canonical_name").alias("query")), m)
    out = e.join(best, (e["_scope"] == best["scope"]) & (e["canonical_name"] == best["query"]), "left")
    score = F.coalesce("score", F.lit(0.0))
    return out.select("state", "name", "canonical_name", F.col("choice").alias("master"), score.alias("score"), match_class(score))


def merge_websites(clubs: DataFrame, key: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """ER-18: the first source that has a website; the stored one is never overwritten."""
    found, labels = [F.col("website")], [(F.col("website"), "stored")]
    for i, (label, frame) in enumerate(sources):
        side = frame.groupBy(F.col(key).alias(f"_k{i}")).agg(F.min(F.nullif(F.trim("website"), F.lit(""))).alias(f"_w{i}"))
        clubs = clubs.join(side, clubs[key] == side[f"_k{i}"], "left").drop(f"_k{i}")
        found.append(F.col(f"_w{i}"))
        labels.append((F.col(f"_w{i}"), label))
    label = None
    for c, name in labels:
        label = F.when(c.isNotNull(), name) if label is None else label.when(c.isNotNull(), name)
    return clubs.withColumns({"website_source": label, "_site": F.coalesce(*found)}).withColumn("website", F.col("_site")).drop("_site", *(f"_w{i}" for i in range(len(sources))))


def master_people(discoveries: DataFrame, key: str, name: str, email: str, club: str) -> DataFrame:
    """ER-19: the least id of each person hash, and every row's link to it."""
    hashed = discoveries.withColumn("person_hash", person_hash(F.col(name), F.col(email), F.col(club)))
    ids = hashed.groupBy("person_hash").agg(F.min(key).alias("person_id"), F.count("*").alias("n_rows"))
    return hashed.select(key, "person_hash").join(ids, "person_hash")


def rehash(people: DataFrame, discoveries: DataFrame) -> DataFrame:
    """ER-20: people without e-mail hashed anew; of equal hashes the least id wins.

    ``people (id, display_name, primary_email, manually_merged)``, ``discoveries (id,
    person_id, name, last_seen_at)``. The name is the one last seen, else the stored
    one. Manually merged people are left out. Returns ``id, person_hash, winner_id,
    group_size``; where ``id`` is not the winner, its discoveries move (``redirect``).
    """
    seen = discoveries.where("person_id IS NOT NULL").groupBy(F.col("person_id").alias("_p")).agg(F.max_by("name", F.struct("last_seen_at", "id")).alias("_name"))
    own = people.where(F.col("primary_email").isNull() & ~F.coalesce("manually_merged", F.lit(False)))
    hashed = own.join(seen, own["id"] == seen["_p"], "left").select("id", person_hash(F.coalesce("_name", "display_name"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("person_hash"))
    groups = hashed.groupBy("person_hash").agg(F.min("id").alias("winner_id"), F.count("*").alias("group_size"))
    return hashed.join(groups, "person_hash").select("id", "person_hash", "winner_id", "group_size")


def relink(discoveries: DataFrame, people: DataFrame) -> DataFrame:
    """ER-21: discoveries without a person take the one with their hash (``id, person_id, relinked``).

    ``discoveries (id, person_id, name, email)``, ``people (id, person_hash,
    manually_merged)``; manually merged people take none.
    """
    side = people.where(~F.coalesce("manually_merged", F.lit(False))).groupBy("person_hash").agg(F.min("id").alias("_to"))
    hashed = discoveries.withColumn("person_hash", F.when(F.col("person_id").isNull(), person_hash(F.col("name"), F.col("email"), F.lit(None).cast("string"))))
    out = hashed.join(side, "person_hash", "left")
    return out.select("id", F.coalesce("person_id", "_to").alias("person_id"), (F.col("person_id").isNull() & F.col("_to").isNotNull()).alias("relinked"))


def deletable(df: DataFrame, key: str, name: str, junk: list[str], references: dict[str, tuple[DataFrame, str]], longest: int = 80) -> DataFrame:
    """ER-22: junk names (too long or listed) with the rows of every referring table, deletable without any.

    ``references``: label -> (table, column); each label becomes a column of counts.
    """
    out = df.where((F.length(name) > longest) | F.lower(F.trim(name)).isin(junk))
    total = F.lit(0)
    for label, (frame, column) in references.items():
        n = frame.groupBy(F.col(column).alias(f"_k_{label}")).agg(F.count("*").alias(f"_n_{label}"))
        out = out.join(n, out[key] == n[f"_k_{label}"], "left").withColumn(label, F.coalesce(f"_n_{label}", F.lit(0)))
        total = total + F.col(label)
    return out.withColumn("references", total).withColumn("deletable", F.col("references") == 0).select(*df.columns, *references, "references", "deletable")


def seed_clubs(rows: DataFrame, name: str, order: str, columns: list[str], affiliation: str | None = None) -> DataFrame:
    """ER-23: one club for each slug, first values win, with its aliases and ``affiliations`` (distinct)."""
    from .aggregates import merge_first

    keyed = rows.withColumn("slug", names.slug(F.col(name)))
    sets = [F.array_sort(F.collect_set(name)).alias("aliases"), *([F.array_sort(F.collect_set(affiliation)).alias("affiliations")] if affiliation else [])]
    gathered = keyed.groupBy(F.col("slug").alias("key")).agg(*sets)
    return merge_first(keyed, F.col("slug"), order, columns).join(gathered, "key").withColumnRenamed("key", "slug")


def club_completeness(columns: list[str]) -> Column:
    return completeness(columns)

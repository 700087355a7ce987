"""Merges, splits and cutovers against loops of one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.functions import classify, names
from touchline.operators import entity, merging


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merge(spark):
    clubs = spark.createDataFrame([(1, "A", False), (2, "B", None), (3, "C", False), (4, "D", True), (5, "E", False), (6, None, False)], "id long, name string, manually_merged boolean").withColumn("state", F.lit("TX"))
    losers = spark.createDataFrame([(2, 1), (3, 2), (4, 1), (5, 4), (9, 1), (5, 99), (1, 1), (6, 1)], "loser long, winner long")
    aliases = spark.createDataFrame([(1, "B", "manual", None), (3, "Cee", "manual", None), (2, "Cee", "manual", None)], "club_id long, alias string, source string, merged_from long")
    spots = spark.createDataFrame([(1, "x", 10), (2, "x", 11), (3, "y", 12), (2, "y", 13), (3, None, 14), (2, None, 15), (5, "x", 16)], "club int, season string, n int")
    career = spark.createDataFrame([("club", 2, "u"), ("college", 2, "u"), ("club", 1, "u"), ("college", 1, "u"), ("club", 3, "v")], "kind string, entity int, coach string")
    refs = [merging.Reference("spots", "club", ["season"]), merging.Reference("career", "entity", ["coach"], F.col("kind") == "club")]
    out, outcome, counts = merging.merge_clubs(clubs, aliases, {"spots": spots, "career": career}, refs, losers)
    assert rows(outcome) == sorted([(2, 1, None), (3, 2, None), (6, 1, None), (4, 1, "manually merged"), (5, 4, "manually merged"), (9, 1, "loser already absent"), (5, 99, "winner not found"), (1, 1, "same id")], key=repr)
    assert rows(out["clubs"].select("id")) == [(1,), (4,), (5,)]
    assert rows(out["spots"]) == sorted([(1, "x", 10), (1, "y", 13), (1, None, 14), (1, None, 15), (5, "x", 16)], key=repr)
    assert rows(out["career"]) == sorted([("club", 1, "u"), ("college", 2, "u"), ("college", 1, "u"), ("club", 1, "v")], key=repr)
    assert rows(out["aliases"]) == sorted([(1, "B", "manual", None), (1, "Cee", "manual", None), (1, "C", "merger-auto", 3)], key=repr)
    assert rows(counts) == [("career.entity", 1, 1), ("spots.club", 3, 2)]
    with pytest.raises(ValueError, match="circle"):
        merging.merge_clubs(clubs, aliases, {}, [], spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "loser long, winner long"))


def test_merge_reviewed(spark):
    clubs = spark.createDataFrame([(k, f"c{k}", False) for k in range(1, 6)], "id long, name string, manually_merged boolean")
    pairs = spark.createDataFrame([(1, 2, "pending", 2), (3, 4, "rejected", 3), (4, 5, "pending", 9), (3, 5, "pending", None)], "a long, b long, status string, winner long")
    lines = spark.createDataFrame([(1, 7), (2, 7), (5, 8)], "club long, n int")
    out, after = merging.merge_reviewed(clubs, {"lines": lines}, [merging.Reference("lines", "club")], pairs)
    assert rows(after.select("a", "b", "status")) == [(1, 2, "merged"), (3, 4, "rejected"), (3, 5, "pending"), (4, 5, "pending")]
    assert rows(out["lines"]) == [(2, 7), (2, 7), (5, 8)] and rows(out["clubs"].select("id", "manually_merged")) == [(2, True), (3, False), (4, False), (5, False)]


def test_split(spark):
    rnd = random.Random(3)
    roots = ["solar north", "rush", "beach city"]
    raw = lambda: rnd.choice([f"{rnd.choice(roots).title()} U1{rnd.randrange(9)} Boys", rnd.choice(roots), "Other FC", None, ""])
    clubs = spark.createDataFrame([(1, "Solar", "TX"), (2, "Rush", None)], "id long, name string, state string")
    events = [(k, rnd.choice([1, 2, 3, None]), raw()) for k in range(60)]
    matches = [(k, rnd.choice([1, 2]), raw(), rnd.choice([1, 2]), raw()) for k in range(60)]
    aliases = [(k, rnd.choice([1, 2]), raw()) for k in range(30)]
    asked = [(1, " Rush ", "Rush 2"), (1, "beach city", "Beach"), (2, "solar north", "Solar N"), (8, "rush", "Gone"), (1, "", "Blank")]
    tables = {"events": spark.createDataFrame(events, "k int, club int, raw string"), "matches": spark.createDataFrame(matches, "k int, home long, home_name string, away long, away_name string")}
    refs = [("events", "club", "raw"), ("matches", "home", "home_name"), ("matches", "away", "away_name")]
    out, made, counts = merging.split_clubs(clubs, spark.createDataFrame(aliases, "id int, club_id long, alias string"), tables, refs, spark.createDataFrame(asked, "source_id long, root string, new_name string"))
    new = {(1, "beach city"): 3, (1, "rush"): 4, (2, "solar north"): 5}
    assert rows(made.select("source_id", "root", "name", "state", "id")) == sorted([(1, "beach city", "Beach", "TX", 3), (1, "rush", "Rush 2", "TX", 4), (2, "solar north", "Solar N", None, 5)], key=repr)
    every = sorted({r for r in [*(e[2] for e in events), *(m[2] for m in matches), *(m[4] for m in matches), *(a[2] for a in aliases)] if r})
    root = {r.x: r.s.lower() for r in spark.createDataFrame([(x,) for x in every], "x string").select("x", names.without_team_words(F.col("x")).alias("s")).collect()}
    to = lambda club, name: new.get((club, root.get(name)), club)
    assert rows(out["events"]) == sorted([(k, to(c, r), r) for k, c, r in events], key=repr)
    assert rows(out["matches"]) == sorted([(k, to(h, hn), hn, to(a, an), an) for k, h, hn, a, an in matches], key=repr)
    assert rows(out["aliases"]) == sorted([(k, to(c, r), r) for k, c, r in aliases], key=repr)
    assert {(r.place, r.root): r.moved for r in counts.collect()}[("events.club", "rush")] == sum(c == 1 and root.get(r) == "rush" for _, c, r in events)
    assert rows(out["clubs"].select("id")) == [(k,) for k in range(1, 6)]


def test_rehash(spark):
    people = spark.createDataFrame([(1, "Ann Lee", None, False, "h1"), (2, "ann lee", None, False, "h2"), (3, "Bo", None, False, "h3"), (4, "Ann Lee", None, True, "h4"), (5, "Ann Lee", "a@b", False, "h5")], "id long, display_name string, primary_email string, manually_merged boolean, person_hash string")
    found = spark.createDataFrame([(10, 2, "Ann Lee", 1), (11, 2, "Ann Lee", 2), (12, 3, None, 1), (13, None, "x", 1)], "id long, person_id long, name string, last_seen_at int")
    left, moved, audit = merging.apply_rehash(entity.rehash(people, found.where("person_id <> 3")), people, found)
    assert rows(left.select("id")) == [(1,), (3,), (4,), (5,)] and rows(moved.select("id", "person_id")) == [(10, 1), (11, 1), (12, 3), (13, None)]
    want = spark.range(1).select(classify.person_hash(F.lit("Ann Lee"), F.lit(None).cast("string"), F.lit(None).cast("string"))).first()[0]
    assert rows(audit) == [(1, 2, want, 2)] and {r.id: r.person_hash for r in left.collect()}[1] == want
    assert {r.id: r.person_hash for r in left.collect()}[4] == "h4"


def test_metadata_and_history(spark):
    old = spark.createDataFrame([(1, '{"a":1,"b":"x"}'), (2, '{"a":1}'), (3, None), (4, '{"a":1}')], "id int, metadata string")
    new = spark.createDataFrame([(1, '{"b": "x", "a": 1}'), (2, '{"a":2}'), (3, '{"a":1}'), (5, "{}")], "id int, metadata string")
    assert rows(merging.upsert_metadata(old, new, ["id"], "metadata").select("id", "action")) == [(1, "unchanged"), (2, "updated"), (3, "updated"), (4, "kept"), (5, "inserted")]
    schema = "day string, k int, n int"
    history = spark.createDataFrame([("2024-01-01", 1, 1), ("2024-12-30", 1, 2), ("2024-12-31", 1, 3), ("2024-12-31", 2, 4)], schema).withColumn("day", F.to_date("day"))
    today = spark.createDataFrame([("2024-12-31", 1, 9)], schema).withColumn("day", F.to_date("day"))
    got = merging.coverage_history(history, today, ["k"], "day", 30)
    assert [(str(a), b, c) for a, b, c in rows(got)] == [("2024-12-30", 1, 2), ("2024-12-31", 1, 9), ("2024-12-31", 2, 4)]
    assert [str(r.day) for r in merging.latest_days(history.select("day").distinct(), "day", 2).collect()] == ["2024-12-30", "2024-12-31"]

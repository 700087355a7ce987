"""Similarity joins and the linker of many tables, against loops over all pairs and all rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from touchline.functions import names, similarity
from touchline.operators import entity, fuzzy, linking

WORDS = ["solar", "crossfire", "premier", "beach", "city", "stars", "united", "fc", "sc", "academy", "north", "dallas", "texas"]


def some_names(seed, n, words=WORDS, typos=2, most=4):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        s = list(" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, most + 1))))
        for _ in range(rnd.randrange(typos + 1)):
            s[rnd.randrange(len(s))] = rnd.choice("abcdestx ")
        out.add(" ".join("".join(s).split()))
    return sorted(out - {""})


@pytest.mark.parametrize("hot", [1 << 20, 60, 1])
def test_set_ratio_pairs_lose_nothing(spark, hot):
    q, c = [*some_names(1, 90), "starsx", "norxth", "q"], some_names(2, 110)
    frame = lambda t: spark.createDataFrame([(x,) for x in t], "_text string").withColumn("_scope", F.lit("s"))
    got = {(r._q, r._c): round(r.score, 6) for r in fuzzy.set_ratio_pairs(frame(q), frame(c), 88, hot).collect()}
    want = {(a, b): round(similarity.set_ratio(a, b), 6) for a in q for b in c if similarity.set_ratio(a, b) >= 88}
    assert got == want and len(want) > 50


def test_set_ratio_pairs_try_few(spark):
    """A token that all names have brings no pair of strangers together."""
    rnd = random.Random(3)
    texts = sorted({"fc " + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(400)})
    frame = spark.createDataFrame([("", x) for x in texts], "_scope string, _text string")
    assert fuzzy.set_ratio_pairs(frame, frame, 88, 1000).count() == len(texts)
    sides = frame.withColumn("_rare", F.array(F.element_at(F.split("_text", " "), 2))).withColumn("_hot", F.array(F.lit("fc")))
    assert fuzzy._by_hot_tokens(sides, sides, 88).distinct().count() < len(texts) ** 2 / 50


def test_winkler_pairs_lose_nothing(spark):
    texts = sorted({*some_names(5, 120, typos=3), "martha", "marhta", "dwayne", "duane", "a", "b", "ab", "ba"})
    frame = spark.createDataFrame([("s", x) for x in texts], "_scope string, _text string")
    got = {(r.a, r.b): round(r.jw, 9) for r in fuzzy.winkler_pairs(frame).collect()}
    want = {(a, b): round(similarity.winkler(a, b), 9) for a, b in itertools.combinations(texts, 2) if similarity.winkler(a, b) >= 0.9}
    assert got == want and ("marhta", "martha") in want


def test_best_matches_are_the_best(spark):
    q = [("A", x) for x in some_names(7, 60)] + [("B", x) for x in some_names(8, 25)] + [("C", "alone"), ("A", "zzz"), ("A", "stars solar"), ("A", "ÜÜ")]
    c = [("A", x) for x in some_names(9, 70)] + [("B", x) for x in some_names(10, 30)] + [("A", "solar stars"), ("A", "stars  solar")]
    ranked = [(s, x, k) for k, (s, x) in enumerate(random.Random(1).sample(c, len(c)))]
    found = fuzzy.best_matches(spark.createDataFrame(q, "_scope string, query string"), spark.createDataFrame(ranked, "_scope string, choice string, rank long"))
    got = {(r.scope, r["query"]): (r.choice, round(r.score, 6)) for r in found.collect()}
    want = {}
    for s, x in q:
        best = (0, None)
        for s2, y, _ in ranked:
            if s2 == s and similarity.sorted_ratio(x, y) > best[0]:
                best = (similarity.sorted_ratio(x, y), y)
        if best[1]:
            want[s, x] = (best[1], round(best[0], 6))
    assert got == want


def test_diff_with_master(spark):
    external = spark.createDataFrame([("tx", "Solar SC (North)"), ("TX", "Nothing"), ("ri", "Lone Star"), (None, "Ghost"), ("TX", None)], "state string, name string")
    master = spark.createDataFrame([(2, "TX", "SC Solar"), (1, "Tx ", "Solar SC"), (3, "TX", ""), (4, "OK", "Lone Star")], "id long, state string, name string")
    got = {(r.state, r.name): (r.master, round(r.score, 1), r["class"] if "class" in r else r[-1]) for r in entity.diff_with_master(external, master).collect()}
    assert got["tx", "Solar SC (North)"][:2] == ("Solar Sc", 100.0) and got["ri", "Lone Star"] == (None, 0.0, "NET_NEW") and got[None, "Ghost"][0] is None and len(got) == 5


# --- linker ----------------------------------------------------------------------

def loop(rows, canonicals, aliases, ignored, short_of, least=88):
    """One row after the other, as a scalar program would."""
    alias, name = {}, {}
    for i, n in sorted(canonicals, key=lambda x: x[0]):
        name[n.strip().lower()] = i
    for i, n in sorted((a for a in aliases if a[0] is not None), key=lambda x: x[0]):
        alias[n.strip().lower()] = i
    choices = sorted({*name.items(), *alias.items()})
    skip = {x.lower() for x in ignored}
    out, added = [], []
    for target, row, raw in rows:
        if raw.lower() in skip:
            out.append((target, row, None, 0))
            continue
        own, short = raw.strip().lower(), short_of[raw].lower()
        hit = next(((alias[k], 1) for k in (own, short) if k and k in alias), None) or next(((name[k], 2) for k in (own, short) if k and k in name), None)
        query = short or own
        if not hit and query:
            scored = sorted((-similarity.set_ratio(query, c), c, i) for c, i in choices if similarity.set_ratio(query, c) >= least)
            def unsafe(c):
                a, b = set(query.split()), set(c.split())
                return len(b) <= 2 and b < a and len(a) >= 2 * len(b)
            scored = [x for x in scored if not unsafe(x[1])]
            if scored:
                hit = (scored[0][2], 3)
                alias[query] = hit[0]
                added.append((hit[0], query))
        out.append((target, row, *(hit or (None, 4))))
    return out, added


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linker_equals_a_loop(spark, seed):
    rnd = random.Random(seed)
    base = some_names(seed, 30, typos=0)
    canonicals = [(k, rnd.choice([n, n.title(), n.upper()])) for k, n in enumerate(base)] + [(90, "Rush 07"), (91, "St. Louis"), (92, "galaxy stars"), (93, "galaxy stars u15")]
    aliases = [(k, n + " xx") for k, n in enumerate(base) if k % 7 == 0] + [(None, "void")]
    tails = ["", " U15", " U15 Boys", " 2011 Girls", " VA", " Boys U15 2010 VA", " 07", "x"]
    pool = [rnd.choice([n, n.title(), n[:-1] + "q" if len(n) > 6 else n]) + rnd.choice(tails) for n in base * 4] + ["galaxy starsx U15", "galaxy starsx", "Galaxy Starsx u15 U16", "St Louis", " ", "U15", "Rush 07", "void"]
    tables, rows = {}, []
    for t in ("home", "away", "tryouts", "rosters"):
        picked = [(k, rnd.choice([*pool, None, ""]), rnd.choice([None, None, None, 7])) for k in range(70)]
        tables[t] = picked
        rows += [(t, k, raw) for k, raw, fk in picked if fk is None and raw]
    ignored = [base[0], "st louis", None]
    all_raw = sorted({r[2] for r in rows})
    short = {r.raw: r.s for r in spark.createDataFrame([(x,) for x in all_raw], "raw string").select("raw", names.without_team_words(F.col("raw")).alias("s")).collect()}
    want, added = loop(rows, canonicals, aliases, [x for x in ignored if x], short)
    targets = [linking.Target(t, spark.createDataFrame(v, "key long, team string, club int").repartition(3), "key", "team", "club") for t, v in tables.items()]
    linked, found, after = linking.link_all(targets, spark.createDataFrame(canonicals, "id long, name string"), spark.createDataFrame(aliases, "club_id long, alias string"), spark.createDataFrame([(x,) for x in ignored], "raw_team_name string"))
    got = sorted((r.target, r.id, r.club_id, r["pass"]) for r in found.collect())
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    assert sorted((r.club_id, r.alias) for r in after.where("source = 'linker-fuzzy'").collect()) == sorted(set(added)) and added
    ids = {(t, k): c for t, k, c, _ in want}
    for t, v in tables.items():
        assert {r.key: r.club for r in linked[t].collect()} == {k: fk if fk is not None else ids.get((t, k)) for k, _, fk in v}
    stats = {r.target: r for r in linking.linker_stats(found).collect()}
    assert all(stats[t].pass_3 == sum(x[0] == t and x[3] == 3 for x in want) for t in tables)


def test_warm_alias_takes_over_from_a_canonical_name(spark):
    """A name is found by its own canonical form until the fuzzy pass has added its short form as an alias."""
    canonicals = spark.createDataFrame([(1, "blue rapids north u15"), (2, "blue rapids northx")], "id long, name string")
    none = spark.createDataFrame([], "club_id long, alias string")
    rows = [(1, "Blue Rapids North U15", None), (2, "Blue Rapids North U16", None), (3, "Blue Rapids North U15", None)]
    target = linking.Target("t", spark.createDataFrame(rows, "id long, team string, club long"), "id", "team", "club")
    _, found, after = linking.link_all([target], canonicals, none)
    first, second, third = sorted((r.id, r.club_id, r["pass"]) for r in found.collect())
    assert first == (1, 1, 2) and second[2] == 3 and third == (3, second[1], 1)
    assert [r.action for r in after.collect()] == ["inserted"]


def test_promote(spark):
    old = spark.createDataFrame([(1, "a", "manual"), (1, "b", "linker-fuzzy"), (2, "c", None)], "club_id long, alias string, source string")
    got = {(r.club_id, r.alias): (r.source, r.action) for r in linking.promote(old, spark.createDataFrame([(1, "a"), (1, "b"), (3, "d")], "club_id long, alias string")).collect()}
    assert got == {(1, "a"): ("linker-fuzzy", "updated"), (1, "b"): ("linker-fuzzy", "unchanged"), (2, "c"): (None, "kept"), (3, "d"): ("linker-fuzzy", "inserted")}


def test_names_are_worked_out_once_not_for_every_row(spark, monkeypatch):
    """The forms of a name (regular expressions) are those of different names: no plan on rows holds them."""
    seen = []
    real = entity.cut

    def noting(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(entity, "cut", noting)
    rows = spark.range(3000).select("id", F.lit("WA").alias("state"), F.concat(F.lit("Solar North "), (F.col("id") % 3).cast("string"), F.lit(" U15 Boys Gold")).alias("name"))
    clubs = rows.withColumn("name", F.concat(F.lit("solar north "), (F.col("id") % 3).cast("string")))
    linked = entity.link_names(rows, "name", clubs, spark.createDataFrame([], "club_id long, alias string"))
    schools = entity.link_schools(rows, clubs, clubs.limit(0))
    diff = entity.diff_with_master(rows, clubs)
    plans = [*seen, *(df._jdf.queryExecution().optimizedPlan().toString() for df in (linked, schools, diff))]
    assert not [p for p in plans if "Range (" in p and "(?i)" in p]
    assert sorted((r["name"], r.master) for r in diff.collect()) == [(f"Solar North {k} U15 Boys Gold", f"Solar North {k}") for k in range(3)]
    assert [r.club_id for r in linked.orderBy("raw").collect()] == [2997, 2998, 2999]

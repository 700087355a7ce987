"""Operators on small frames, against what the rules say."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from touchline.functions import similarity
from touchline.operators import aggregates, cdc, entity, filters, joins, quality, upsert, windows
from touchline.sources import html, scans, sinks
from touchline.streaming import streams


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_standings_skip_and_null_keys(spark):
    schema = "status string, home_club_id int, away_club_id int, home_score int, away_score int, season string, league string, division string, age_group string, gender string"
    data = [
        ("final", 1, 2, 3, 1, "s", None, "d", "U", "M"),
        ("final", 2, 1, 2, 2, "s", None, "d", "U", "M"),
        ("final", 1, None, 2, 2, "s", None, "d", "U", "M"),
        ("scheduled", 1, 2, 0, 0, "s", None, "d", "U", "M"),
        ("final", 1, 2, None, 0, "s", None, "d", "U", "M"),
        ("final", 1, 2, 1, 0, None, None, "d", "U", "M"),
    ]
    m = spark.createDataFrame(data, schema)
    got = aggregates.standings(m).select("club_id", "wins", "losses", "draws", "goals_for", "goals_against", "matches_played")
    assert rows(got) == [(1, 1, 0, 1, 5, 3, 2), (2, 0, 1, 1, 3, 5, 2)]
    assert aggregates.unlinked_matches(m).first()[0] == 1


def test_streak(spark):
    data = [("a", i, s) for i, s in enumerate("FFOFF")] + [("b", i, "F") for i in range(3)] + [("c", 0, "O")]
    df = spark.createDataFrame(data, "k string, t int, s string").withColumn("id", F.col("t"))
    assert rows(windows.failure_streak(df, "k", "t", "id", F.col("s") == "F")) == [("a", 2), ("b", 3), ("c", 0)]


def test_upsert_actions(spark):
    old = spark.createDataFrame([(1, "a", 5.0), (2, None, 5.0), (None, "z", 1.0)], "k int, v string, c double")
    new = spark.createDataFrame([(1, "b", 4.0), (2, "x", 4.0), (3, "n", 1.0), (None, "z", 1.0)], "k int, v string, c double")
    got = {r.k: (r.v, r.action) for r in upsert.upsert(old, new, ["k"], upsert.by_confidence("c")).collect()}
    assert got == {1: ("a", "unchanged"), 2: ("x", "updated"), 3: ("n", "inserted"), None: ("z", "unchanged")}
    again = upsert.upsert(new, new, ["k"], upsert.new_wins)
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_late_platform_id(spark):
    schema = "pid string, day string, team string, score int"
    old = spark.createDataFrame([(None, "d1", "x", 1), (None, None, "y", 1)], schema)
    new = spark.createDataFrame([("p1", "d1", "x", 2), (None, None, "y", 3)], schema)
    got = upsert.upsert_by_platform_id(old, new, "pid", {"day": "1970", "team": ""})
    assert rows(got.select("team", "pid", "score"), "team") == [("x", "p1", 2), ("y", None, 3)]


def test_redirect_collisions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, None), (1, None)], "club int, league string")
    losers = spark.createDataFrame([(2, 1)], "loser int, winner int")
    got = sorted(map(str, rows(upsert.redirect(df, "club", losers, ["league"]))))
    assert got == sorted(map(str, [(1, "a"), (1, "b"), (1, None), (1, None)]))


def test_chains_and_circles(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 4)], "loser int, winner int")
    assert rows(entity.resolve_chains(chain)) == [(1, 4), (2, 4), (3, 4), (9, 4)]
    with pytest.raises(ValueError):
        entity.resolve_chains(spark.createDataFrame([(1, 2), (2, 1)], "loser int, winner int"))


def test_snapshot_diff(spark):
    data = [("c", 1, "p", "1", "gk"), ("c", 2, "p", "2", "df"), ("c", 2, "q", "", None), ("c", 3, "q", None, ""), ("x", 1, "z", "1", "1")]
    df = spark.createDataFrame(data, "club string, at int, player string, jersey string, position string")
    got = cdc.snapshot_diff(df, ["club"], "at", "player", ["jersey", "position"])
    assert rows(got.select("at", "player", "diff_type")) == [(2, "p", "jersey_changed"), (2, "p", "position_changed"), (2, "q", "added"), (3, "p", "removed")]


def greedy(names, least):
    kept = []
    for n in names:
        if all(similarity.sorted_ratio(k, n) < least for k in kept):
            kept.append(n)
    return kept


def test_greedy_dedup_is_order_dependent_and_whole(spark):
    rnd = random.Random(5)
    base = ["alpha beta united", "solar north", "crossfire premier", "beach city stars"]
    data = []
    for i in range(120):
        s = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            s[rnd.randrange(len(s))] = rnd.choice("abcdefgh ")
        data.append((i, " ".join("".join(s).split())))
    df = spark.createDataFrame(data, "id int, name string").repartition(3)
    want = greedy([n for _, n in data], 88)
    assert [n for _, n in rows(entity.greedy_dedup(df, "id", "name"), "id")] == want


def test_no_candidate_is_lost(spark):
    rnd = random.Random(2)
    texts = sorted({"".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 14))).strip() or "a" for _ in range(120)})
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {tuple(r) for r in entity.indel_candidates(df, "k", "t", 80).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if similarity.indel_ratio(a, b) >= 80}
    assert want <= got


def test_linker_passes(spark):
    raw = spark.createDataFrame([("Solar SC U15 Boys",), ("NUFC",), ("Cedar Stars Bergen",), ("Nothing Like It",), ("Concorde Fire Academy 2010",)], "raw string")
    clubs = spark.createDataFrame([(1, "Solar SC"), (2, "Newcastle United"), (3, "Stars"), (4, "Cedar Stars Bergen Academy")], "id int, name string")
    aliases = spark.createDataFrame([(2, "nufc"), (None, "x"), (5, "concorde fire")], "club_id int, alias string")
    got = {r.raw: (r.club_id, r["pass"]) for r in entity.link_names(raw, "raw", clubs, aliases).collect()}
    assert got == {"Solar SC U15 Boys": (1, 2), "NUFC": (2, 1), "Cedar Stars Bergen": (4, 3), "Nothing Like It": (None, 4), "Concorde Fire Academy 2010": (5, 1)}


def test_tiers(spark):
    pairs = spark.createDataFrame([(1, 2, 0.97), (3, 4, 0.9), (5, 6, 0.99), (7, 8, 0.99), (1, 99, 0.99)], "a_id int, b_id int, similarity double")
    meta = spark.createDataFrame(
        [(1, "A B", "wa", None, False, 3), (2, "A  B", "WA", None, False, 5), (3, "C D", "OR", None, False, 1), (4, "C E", "OR", None, False, 1), (5, "E F", "OR", "a.org", False, 1), (6, "E F", "OR", "b.org", False, 1), (7, "G H", "OR", None, True, 1), (8, "G H", "OR", None, False, 1)],
        "id int, name string, state string, website string, manually_merged boolean, completeness int",
    )
    got = {(r.a_id, r.b_id): (r.tier, r.winner) for r in entity.tier_pairs(pairs, meta, "id").collect()}
    assert got == {(1, 2): ("auto_merge", 2), (3, 4): ("review", None), (5, 6): ("review", None), (7, 8): ("skip", None), (1, 99): ("skip", None)}


def test_filters(spark):
    df = spark.createDataFrame([(1, "50%", "a"), (2, "500", ""), (3, None, None)], "id int, v string, w string")
    assert rows(df.where(filters.contains_any_case(F.col("v"), "0%")).select("id")) == [(1,)]
    assert rows(df.where(filters.present(F.col("w"), False)).select("id")) == [(2,), (3,)]
    assert filters.where_all(df, None, None).count() == 3
    assert filters.clamp_page(0, 1000) == (1, 100)
    assert df.where(filters.status_is(F.col("v"), "odd", [], strict=True)).count() == 0
    with pytest.raises(ValueError):
        filters.in_ids(F.col("id"), ["1"])
    with pytest.raises(ValueError):
        filters.between(F.col("id"), "no date", None)
    good, bad = filters.split_valid(df, [(filters.blank(F.col("v")), "no v"), (filters.blank(F.col("w")), "no w")])
    assert (good.count(), rows(bad.select("id", "reason"))) == (1, [(2, "no w"), (3, "no v")])


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 7, "z")], "k string, rt int, v string")
    assert rows(joins.as_of(left, right, ["k"], "t", "rt", ["v"])) == [("a", 1, None), ("a", 5, "y"), ("b", 9, None)]


def test_containing_meets_short_names(spark):
    texts = spark.createDataFrame([(1, "The Ab club"), (2, None), (3, "xyz 100% Solar")], "id int, t string")
    wanted = spark.createDataFrame([("ab",), ("solar",), ("100%",), ("",), ("zz",)], "n string")
    assert rows(joins.containing(texts, "t", wanted, "n").select("id", "n")) == [(1, "ab"), (3, "100%"), (3, "solar")]


def test_quality(spark):
    df = spark.createDataFrame([("Home",), ("12/3",), ("Tom 14",), ("# 14",), ("",), ("Jane Smith",), ("Head Coach Al",), ("jane Smith",), ("JANE SMITH",), ("Meet  The!",), ("Ann B. C. D. E",), ("Élodie Roux",), ("Al 'Bo Cy",)], "n string")
    got = dict(rows(df.select("n", quality.name_problem(F.col("n")).alias("r"))))
    assert got == {
        "Home": "wrong_token_count", "12/3": "wrong_token_count", "Tom 14": "not_alpha_start", "# 14": "first_char_not_upper", "": "too_short", "Jane Smith": None, "Head Coach Al": "token_in_blocklist",
        "jane Smith": "first_char_not_upper", "JANE SMITH": "all_caps", "Meet  The!": "in_blocklist", "Ann B. C. D. E": "wrong_token_count", "Élodie Roux": None, "Al 'Bo Cy": "not_alpha_start",
    }
    assert dict(rows(df.select("n", quality.fragment_kind(F.upper("n")).alias("r"))))["Home"] is None
    assert rows(df.limit(1).select(quality.fragment_kind(F.lit(" contact US ")).alias("a"), quality.fragment_kind(F.lit("One week")).alias("b"))) == [("nav_label", "pricing_or_date")]
    assert rows(df.where(quality.is_numeric_name(F.col("n"))).select("n")) == [("",), ("12/3",)]
    with pytest.raises(ValueError):
        quality.purge(df, F.lit(True), 3)


def test_pages(spark):
    page = """<html><head><title> T </title><script type="application/ld+json">{"@graph":[{"@type":"Club","name":"A"},{"@type":["X","Club"]}]}</script>
    <script>var a = {"b": {"c": "}"}};</script></head><table><tr><th>Team</th><th>Score</th></tr><tr><td>A <b>B</b></td><td>3-2</td></tr></table><a href="/x">x</a></html>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, '<script type="application/ld+json">{broken</script>')], "id long, html string")
    assert rows(html.linked_data(df, "id", "html", ["Club"]).select("id", "kind")) == [(1, "Club"), (1, "Club")]
    assert [(r.id, r.cells) for r in html.table_rows(df, "id", "html").collect()] == [(1, {"team": "A B", "score": "3-2"})]
    assert df.select(html.embedded_json(F.col("html"), "var a =")).first()[0] == '{"b": {"c": "}"}}'
    assert df.select(html.title(F.col("html")), F.size(html.links(F.col("html")))).first()[:] == ("T", 1)


def test_scans_and_sinks(spark, tmp_path):
    log = [{"client_run_id": "r", "seq": 1, "scraper_key": "k", "started_at": "2024-01-01T00:00:00", "status": "running"}, {"client_run_id": "r", "seq": 2, "status": "ok", "records_created": 3, "started_at": "2024-01-01T01:00:00"}]
    import json

    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, log)))
    got = scans.consolidate_runs(scans.run_log_events(spark, str(tmp_path / "log.jsonl"))).first()
    assert (got.scraper_key, got.status, got.records_created, str(got.started_at)) == ("k", "ok", 3, "2024-01-01 00:00:00")
    (tmp_path / "c.json").write_text('{"processed": {"7": {"status": "ok", "website": "a.org"}}}')
    assert rows(scans.checkpoint_sites(spark, str(tmp_path / "c.json"))) == [("7", "a.org", "ok")]
    df = spark.createDataFrame([('a"b', None)], "x string, y string")
    sinks.write_csv(df, str(tmp_path / "csv"), ["x", "y"])
    assert rows(scans.csv_strings(spark, str(tmp_path / "csv"), ["x", "y", "z"])) == [('a"b', "", "")]
    assert scans.csv_kind(["Name", "URL"], {"coach": {"coach"}, "url": {"name", "url"}}) == "url"



def test_link_names_finds_swapped_misspelt_names(spark):
    from touchline.functions import similarity as sim

    raws = ["strikers arsenals", "unitedd rangerz", "zebra quartz"]
    choices = [(1, "arsenal striker"), (2, "rangers united"), (3, "harbor lions")]
    canonicals = spark.createDataFrame(choices, "id long, name string")
    raw = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = {r.raw: r.club_id for r in entity.link_names(raw, "raw", canonicals, spark.createDataFrame([], "club_id long, alias string")).collect()}
    scored = raw.crossJoin(canonicals).withColumn("score", sim.token_set_ratio(F.col("raw"), F.col("name"))).where("score >= 88").collect()
    assert got == {**dict.fromkeys(raws), **{r.raw: r.id for r in scored}} and got["strikers arsenals"] == 1


def test_school_linker_passes(spark):
    schools = spark.createDataFrame([(1, "TX", "Austin High School"), (2, "TX", "St. Mary's Academy"), (3, "OK", "Austin High School"), (4, "TX", None)], "id int, state string, name string")
    aliases = spark.createDataFrame([(2, "TX", "Marys"), (1, "TX", "Lee High")], "id int, state string, name string")
    raw = spark.createDataFrame([("tx", " marys"), ("TX", "Austin  High School"), ("TX", "Austin High Schol"), ("OK", "Lee High"), (None, "Marys"), ("TX", None), ("TX", "Hihg Asutin Shcool")], "state string, name string")
    got = {(r.state, r.name): (r.id, r["pass"]) for r in entity.link_schools(raw, schools, aliases).collect()}
    assert got[("tx", " marys")] == (2, 1)
    assert got[("TX", "Austin  High School")] == (1, 2)
    assert got[("TX", "Austin High Schol")] == (1, 3)
    assert got[("OK", "Lee High")] == (None, 4)
    assert got[(None, "Marys")] == (None, 4) and got[("TX", None)] == (None, 4)
    assert len(got) == 7


def test_merge_of_two(spark):
    clubs = spark.createDataFrame([(1, False), (2, True), (3, None)], "id int, manually_merged boolean")
    teams = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "team int, club int")
    out = entity.merge_two({"teams": (teams, "club")}, clubs, "id", 1, 2)
    assert {r.team: r.club for r in out["teams"].collect()} == {10: 1, 11: 1, 12: None}
    assert {r.id: r.manually_merged for r in out["clubs"].collect()} == {1: True, 3: None}
    for winner, loser in ((1, 1), (0, 2), (1, 9)):
        with pytest.raises(ValueError):
            entity.merge_two({}, clubs, "id", winner, loser)


def test_rehash_and_relink(spark):
    people = spark.createDataFrame([(1, "Ann Lee", None, False), (2, "A. Lee", None, False), (3, "Bo", "b@x.org", False), (4, "Ann Lee", None, True), (5, "Cy Roe", None, None)], "id int, display_name string, primary_email string, manually_merged boolean")
    seen = spark.createDataFrame([(1, 2, "ann  lee", "2026-02-01"), (2, 2, "A. Lee", "2026-01-01"), (3, None, "Cy Roe", "2026-01-01")], "id int, person_id int, name string, last_seen_at string")
    hashed = entity.rehash(people, seen)
    assert {r.id: (r.winner_id, r.group_size) for r in hashed.collect()} == {1: (1, 2), 2: (1, 2), 5: (5, 1)}
    stored = hashed.where("id = winner_id").select("id", "person_hash").join(people.select("id", "manually_merged"), "id")
    got = entity.relink(seen.withColumn("email", F.lit(None).cast("string")), stored)
    assert {r.id: (r.person_id, r.relinked) for r in got.collect()} == {1: (2, False), 2: (2, False), 3: (5, True)}


def test_effectiveness_holds_a_bounded_number_of_lines_in_a_task(spark):
    """More tasks tell apart more lines, and the counts are those of whole joins, also for odd keys."""
    from touchline.plans import catalog

    s = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "s_suppkey long")
    li = spark.createDataFrame([(1, 10, 100, "R"), (1, 10, 100, "R"), (1, None, 101, "N"), (1, 11, 103, None), (2, 10, None, "R"), (2, 12, 102, "R"), (None, 10, 100, "R"), (9, 1, 100, "R")], "l_suppkey long, l_partkey long, l_orderkey long, l_returnflag string")
    o = spark.createDataFrame([(100, 5), (100, 6), (101, 7), (102, None), (103, 8), (None, 5)], "o_orderkey long, o_custkey long")
    c = spark.createDataFrame([(5, 0), (6, 1), (7, 0), (8, 2), (None, 1)], "c_custkey long, c_nationkey int")
    n = spark.createDataFrame([(0, "A"), (1, "B"), (1, "A"), (2, None)], "n_nationkey int, n_name string")
    out = catalog._effectiveness(s, li, o, c, n, 7)
    assert {tuple(r) for r in out.collect()} == {(1, 2, 2, 1), (2, 2, 0, 1), (3, 0, 0, 0), (None, 0, 0, 0)}
    assert len(out.collect()) == 4
    assert out._jdf.queryExecution().toString().count(", 7), REPARTITION_BY_NUM") >= 3

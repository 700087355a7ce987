"""Readings of single cells: literal cells with the values they must give."""

import pytest
from pyspark.sql import functions as F

from touchline.functions import classify, dates, names, similarity

CASES = {}


def cells(name, about, inputs, outputs, read, rows):
    """``rows`` hold the ``inputs``, then the ``outputs`` that ``read`` must give (both as DDL)."""
    CASES[name] = ([part.split() for part in inputs.split(", ")], [part.split() for part in outputs.split(", ")], read, rows)


def fields(c, *parts):
    return [c[p] for p in parts]


# --- dates ---------------------------------------------------------------------

cells("date_formats", "DT-01", "cell string", "moment timestamp_ntz", lambda c: [dates.parse_date(c)], [
    ("2026-03-14 15:30", "2026-03-14 15:30:00"), ("2026-03-14T15:30:05", "2026-03-14 15:30:05"), ("3/14/2026 3:30 PM", "2026-03-14 15:30:00"),
    ("Sat, Mar 14 2026 3:30 PM", "2026-03-14 15:30:00"), ("Mar 14, 2026", "2026-03-14 00:00:00"), ("2026-02-30", None), ("soon", None), (None, None),
])
cells("prior_seasons", "DT-03: as one text", "first int, n int", "seasons string", lambda y, n: [F.array_join(dates.seasons_back(y, n), ",")], [
    (2025, 3, "2025-26,2024-25,2023-24"), (2000, 2, "2000-01,1999-00"), (1999, 1, "1999-00"),
])
cells("season_of_text", "DT-04", "cell string", "season string", lambda c: [dates.season_of_text(c)], [
    ("Fall 2025-26 table", "2025-26"), ("2025–26", "2025-26"), ("Champions 2026", "2025-26"), ("2000", "1999-00"), ("none", None), (None, None),
])
cells("grade_year", "DT-07", "cell string, spring int", "grad_year int", lambda c, s: [dates.grad_year_of_grade(c, s)], [
    ("Sr.", 2026, 2026), ("12", 2026, 2026), ("Junior", 2026, 2027), (" 9th ", 2026, 2029), ("Class of 2027", 2026, 2027), ("So", 2026, 2028), ("13", 2026, None), ("", 2026, None), (None, 2026, None),
])
cells("class_year", "DT-08", "cell string", "year string", lambda c: [dates.class_year(c)], [
    ("Fr.", "freshman"), ("RS-Fr.", "freshman"), ("R-So", "sophomore"), ("rs jr", "junior"), ("5th Yr.", "grad"), ("Graduate", "grad"), ("Redshirt Sr", None), ("", None), (None, None),
])
cells("date_ranges", "DT-13", "cell string", "first date, last date", lambda c: fields(dates.date_range(c), "first", "last"), [
    ("Jan 2 - Jan 5, 2026", "2026-01-02", "2026-01-05"), ("January 2-5, 2026", "2026-01-02", "2026-01-05"), ("Feb 28 – Mar 1, 2026", "2026-02-28", "2026-03-01"), ("Jul 4, 2026", "2026-07-04", "2026-07-04"), ("TBD", None, None), (None, None, None),
])
cells("division_age", "DT-14", "division string, season string", "age string", lambda c, s: [dates.age_of_division(c, s)], [
    ("G2008/2007", "2024-25", "U17"), ("B2009", "2024-25", "U16"), ("b2030", "2024-25", "U1"), ("Open", "2024-25", None), ("B2009", None, None), (None, "2024-25", None),
])

# --- names, texts, sites -----------------------------------------------------------

joined = lambda c: F.array_join(c, "|")
cells("club_tokens", "STR-05, with ``|`` between tokens", "cell string", "tokens string", lambda c: [joined(names.tokens(c))], [
    ("Solar FC", "solar|football"), ("Austin Utd.", "austin|united"), ("The Youth Academy", ""), ("AC (Milan)", "athletic|milan"), (None, None),
])
cells("college_tokens", "STR-06", "cell string", "tokens string", lambda c: [joined(names.college_tokens(c, ["university", "college", "of", "the"]))], [
    ("University of Texas, Austin", "texas|austin"), ("The (King's) College", "king's"), ("", ""), (None, None),
])
cells("school_names", "STR-07", "cell string", "name string", lambda c: [names.school_name(c)], [
    ("St. Mary's H.S.", "st mary s h s"), ("  Lee   High-School ", "lee high-school"), ("", ""), (None, None),
])
cells("clean_cells", "STR-10", "cell string", "clean string", lambda c: [names.blank_to_null(c)], [("  a \t b ", "a b"), ("   ", None), ("", None), (None, None)])
cells("websites", "STR-11", "cell string", "site string", lambda c: [names.website(c)], [
    ("HTTPS://www.Club.org/", "club.org"), ("http://club.org/a/", "club.org/a"), ("www.x.com", "x.com"), ("https://", None), ("", None), (None, None),
])
cells("accepted_sites", "STR-13", "cell string", "ok boolean", lambda c: [names.accepted_host(c, ["facebook.com"], [".org", ".com"])], [
    ("https://club.org/x", True), ("https://m.facebook.com/club", False), ("club.xyz", False),
])
cells("without_suffix", "STR-14", "cell string", "name string", lambda c: [names.without_suffix(c, ["ECNL RL", "ECNL"])], [
    ("Solar - ECNL", "Solar"), ("Solar ECNL RL", "Solar"), ("ECNL Solar", "ECNL Solar"), (None, None),
])
cells("plain_texts", "STR-15", "cell string", "text string", lambda c: [names.plain_text(c)], [
    ("<b>A&amp;B</b>&nbsp;c", "A&B c"), ("<p>x</p><p>y</p>", "x y"), ("&amp;lt;", "&lt;"), ("", ""), (None, None),
])
cells("city_and_state", "STR-16", "cell string", "city string, state string", lambda c: fields(names.location(c), "city", "state"), [
    ("Salem, or", "Salem", "OR"), ("Salem", "Salem", None), ("", None, None), (None, None, None),
])
cells("position_and_name", "STR-16", "cell string", "position string, name string", lambda c: fields(names.position_prefix(c), "position", "name"), [
    ("GK  Jo Ann Smith", "GK", "Jo Ann Smith"), ("D/M Kim Lee", "D/M", "Kim Lee"), ("Dominic Roe", None, "Dominic Roe"), ("M", None, "M"), ("F/D X", "F/D", "X"), ("", None, ""), (None, None, ""),
])
cells("name_and_trailer", "STR-16", "cell string", "name string, trailer string", lambda c: fields(names.name_and_trailer(c), "name", "trailer"), [
    ("Ann  Lee (Solar SC)", "Ann Lee", "Solar SC"), ("Ann Lee (Solar (Red))", "Ann Lee", "Solar (Red)"), ("Ann Lee", "Ann Lee", None), ("Ann Lee ()", "Ann Lee", None), ("Ann (Lee", "Ann (Lee", None), (None, None, None),
])
cells("contacts", "STR-17", "cell string", "emails string, phones string", lambda c: [joined(names.emails(c)), joined(names.phones(c))], [
    ("write A@b.org, a@B.org", "a@b.org", ""), ("call (206) 555-0100 or 206.555.0100", "", "206-555-0100"), ("", "", ""), (None, None, None),
])
cells("like_escapes", "STR-19: a literal ``_`` and ``%`` in the pattern", "cell string", "hit boolean", lambda c: [c.like("%" + names.escape_like("a_b%") + "%")], [
    ("xa_b%y", True), ("xaXb%y", False), ("a_bc", False), (None, None),
])
cells("school_states", "STR-20", "cell string", "name string, state string", lambda c: fields(names.state_in_parentheses(c), "name", "state"), [
    ("Antelope  Valley (Calif.)", "Antelope Valley", "CA"), ("Benedictine (KS)", "Benedictine", "KS"), ("Houghton (N.Y.)", "Houghton", "NY"), ("Peru State (Neb.)", "Peru State", "NE"), ("X (New Mexico)", "X", "NM"),
    ("Aquinas", "Aquinas", None), ("A (b) (Ore.)", "A (b)", "OR"), ("X (Narnia)", "X", None), ("", "", None), (None, None, None),
])
cells("college_spellings", "STR-20", "cell string", "name string", lambda c: [names.spelled_out(names.college_name(c))], [
    ("St. Ambrose University", "saint ambrose"), ("Mt. Mercy College", "mount mercy"), ("O'Connell Institute", "o connell"), ("College University", "college"), ("", ""), (None, None),
])
cells("name_extensions", "STR-22", "a string, b string", "extends boolean", lambda a, b: [names.is_extension(a, b)], [("Penn", "Penn State", True), ("penn state", "Penn", True), ("Penn", "Penn", False), ("Penn", "Old Penn", False)])

# --- scores ---------------------------------------------------------------------------

cells("search_scores", "SIM-10", "name_share double, city_share double, in_state boolean, root boolean, keyword boolean", "score int", lambda *c: [similarity.search_score(*c)], [
    (1.0, 1.0, True, True, True, 100), (0.5, 0.0, False, True, False, 40), (0.33, 0.5, False, False, True, 31), (0.0, 0.0, False, False, False, 0),
])
cells("site_confidences", "SIM-11", "status string, logo boolean, socials int, staff boolean", "confidence int", lambda *c: [similarity.site_confidence(*c)], [
    ("dead", True, 5, True, 10), ("active", True, 5, True, 90), ("active", False, 2, False, 40), ("active", False, 0, True, 35),
])
cells("path_confidences", "SIM-12", "path string", "confidence double", lambda c: [similarity.path_confidence(c, ["/coaches", "/staff"], ["/about"])], [("/Staff/list", 1.0), ("/about-us", 0.7), ("/x", 0.5)])
cells("anchor_scores", "SIM-13", "hit boolean, label string, both_genders boolean", "score int", lambda h, t, b: [similarity.anchor_score(h, t, "women", "men's", b)], [
    (True, "Women's Soccer", False, 15), (True, "Men's Soccer", False, 5), (True, "Soccer", True, 9), (False, "Soccer", False, 1), (False, "Golf", False, 0),
])

# --- classes -----------------------------------------------------------------------------

cells("inline_scores", "CLS-02", "cell string", "home int, away int", lambda c: fields(classify.inline_score(c), "home", "away"), [
    ("FC 2010-2012 vs X 3-1", 3, 1), ("final: 2 – 2", 2, 2), ("no score", None, None), (None, None, None),
])
cells("brackets", "CLS-05", "cell string", "age_group string, gender string", lambda c: fields(classify.bracket(c), "age_group", "gender"), [
    ("B15 Premier", "U15", "M"), ("G13 Elite", "U13", "F"), ("U12 Boys", "U12", "M"), ("U9 Girls", "U09", "F"), ("G U-14 Premier", "U14", "F"), ("2010 Girls", "2010", "F"), ("Open", None, None), (None, None, None),
])
cells("tier_labels", "CLS-08", "cell string", "tier string", lambda c: [classify.tier_of_label(c)], [("NPL Member League", "competitive"), ("National Elite", "elite"), ("Regional Tournament", "competitive"), ("ECNL", None), (None, None)])
cells("match_classes", "CLS-12", "score double", "class string", lambda c: [classify.match_class(c)], [(100.0, "DUPLICATE"), (88.0, "DUPLICATE"), (87.9, "NEAR_MATCH"), (75.0, "NEAR_MATCH"), (74.9, "NET_NEW"), (0.0, "NET_NEW")])
cells("failure_kinds", "CLS-13", "message string, exception string", "kind string", lambda m, k: [classify.failure_kind(m, k)], [
    ("Read timed out", None, "timeout"), ("ERR_INTERNET down", None, "network"), ("x", "KeyError", "parse_error"), ("connection timeout", None, "timeout"), ("0 rows", None, "unknown"), (None, None, None),
])
cells("site_statuses", "CLS-16", "http int, first_url string, last_url string, body string", "status string", lambda *c: [classify.site_status(*c)], [
    (404, "https://a.org", "https://a.org", "", "dead"), (200, "https://a.org", "https://b.org/x", "", "redirected"), (200, "https://a.org", "https://www.a.org/x", "Coming soon", "active"), (200, "https://a.org", "https://a.org", "Coming soon, parked by X", "dead"),
])
cells("head_coaches", "CLS-17", "title string", "head boolean", lambda c: [classify.is_head_coach(c)], [("Head Coach", True), ("Head Women's Soccer Coach", True), ("Associate Head Coach", False), ("Coach", False), (None, None)])
cells("loose_ints", "CLS-18", "cell string", "n int", lambda c: [classify.loose_int(c)], [("24pts", 24), (" -3 ", -3), ("pts24", None), ("", None), ("99999999999", None), (None, None)])
cells("grade_spans", "CLS-19", "low string, high string", "from_grade int, to_grade int, high_school boolean", lambda a, b: [classify.grade(a), classify.grade(b), classify.grades_overlap(classify.grade(a), classify.grade(b))], [
    ("PK", "8", -1, 8, False), ("9", "12", 9, 12, True), ("KG", "12", 0, 12, True), ("7", "09", 7, 9, True), (None, "9", None, 9, True), ("UG", None, None, None, False),
])
cells("player_pools", "CLS-20", "title string, slug string, posted string, body string", "tier string, selected int, born int", lambda t, s, p, b: [classify.pool_tier(t, s), classify.selection_year(p), classify.birth_year(b, t, classify.selection_year(p))], [
    ("National Pool named", "id2-pool", "2024-02-08T16:46:00", "players born in 2010", "national", 2024, 2010), ("Regional Camp", "national-team", "2024-02-08", "the U-15 group", "training-center", 2024, 2009),
    ("Rosters", "id-selection", "soon", "2011 age group", None, None, 2011), ("ID selection", "x", "2023", "U30 and born in 1950", "regional", 2023, None), ("id2 2009", "x", None, None, None, None, 2009), (None, None, None, None, None, None, None),
])
gate = lambda s, t, n, r, a: fields(classify.scrape_gate(s, "2025-26", t.cast("timestamp_ntz"), n, r, a, "2026-01-31 00:00:00"), "go", "reason")
cells("scrape_gates", "CLS-21", "season string, scraped string, players int, in_review boolean, attempts int", "go boolean, reason string", gate, [
    ("2020-21", None, 0, False, None, False, "likely_covid_cancelled"), ("2025-26", "2026-01-20 10:00:00", 0, True, 9, False, "fresh:scraped_at=2026-01-20"), ("2025-26", "2025-12-01 10:00:00", 50, True, 9, True, "ok"), ("2025-26", None, 0, False, None, True, "ok"),
    ("2023-24", None, 10, True, 9, False, "historical_has_data:count=10"), ("2023-24", None, 9, True, 9, False, "unresolved_url_needs_review"), ("2023-24", None, 0, False, 3, False, "max_attempts:3"), ("2023-24", None, 0, False, 2, True, "ok"), ("2023-24", None, 0, False, None, True, "ok"),
])
cells("scrape_gates_forced", "CLS-21: a forced season", "season string", "go boolean, reason string", lambda s: fields(classify.scrape_gate(s, "2025-26", F.lit(None).cast("timestamp_ntz"), F.lit(50), F.lit(True), F.lit(9), "2026-01-31 00:00:00", force_season="2020-21"), "go", "reason"), [
    ("2020-21", True, "force_historical"), ("2023-24", False, "historical_has_data:count=50"),
])


@pytest.mark.parametrize("name", sorted(CASES))
def test_cells(spark, name):
    given, made, read, rows = CASES[name]
    one = lambda values, kinds: [F.lit(v).cast(t).alias(n) for (n, t), v in zip(kinds, values, strict=True)]
    frame = spark.range(1).select(F.posexplode(F.array(*(F.struct(*one(r[: len(given)], given), F.struct(*one(r[len(given) :], made)).alias("want")) for r in rows))).alias("at", "r")).select("at", "r.*")
    got = frame.select("at", "want", F.struct(*(c.cast(t).alias(n) for c, (n, t) in zip(read(*(F.col(k) for k, _ in given)), made, strict=True))).alias("got")).orderBy("at").collect()
    assert [r.got for r in got] == [r.want for r in got]

"""Literal cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from touchline.functions import classify, dates, names, similarity


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'string'}" for i, v in enumerate(values)))
    return df.select(column(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


@pytest.mark.parametrize(
    ("raw", "short"),
    [
        ("Concorde Fire Premier 2011 Boys", "Concorde Fire"),
        ("NTH Tophat U15 Boys Gold", "NTH Tophat"),
        ("City SC GA", "City SC"),
        ("Beach FC VA", "Beach FC"),
        ("AYSO United 64 CA", "AYSO United"),
        ("10 (16U) TUSA Gold", "TUSA"),
        ("", ""),
    ],
)
def test_team_words(spark, raw, short):
    assert one(spark, names.without_team_words, raw) == short


@pytest.mark.parametrize(
    ("raw", "canonical"),
    [("FC Dallas", "Fc Dallas"), ("SC Freiburg", "Sc Freiburg"), ("FC Cincinnati", "Fc Cincinnati"), ("Solar Red SC (U-12)", "Solar Red"), ("d'angelo o-neil 1a", "D'Angelo O-Neil 1A"), ("Boys Soccer Club Alpha Beta", "Alpha Beta")],
)
def test_canonical(spark, raw, canonical):
    assert one(spark, names.canonical_name, raw) == canonical


@pytest.mark.parametrize(("raw", "ok"), [("ab", False), ("Skip to content", False), ("follow us now", False), ("Solar SC", True), (None, False)])
def test_valid_name(spark, raw, ok):
    assert one(spark, names.is_valid_name, raw) is ok


def test_sites(spark):
    assert one(spark, names.website, "HTTPS://www.Club.org/") == "club.org"
    assert one(spark, names.website, "https://") is None
    assert one(spark, names.apex_domain, "https://a.b.club.org/x?y") == "club.org"
    assert one(spark, names.slug, "  St. Louis FC!") == "st-louis-fc"
    assert one(spark, names.key_id, "gotsport-events:42") == 42
    assert one(spark, names.key_id, "x:") is None
    assert one(spark, names.emails, "write A@b.org, a@B.org") == ["a@b.org"]
    assert one(spark, names.phones, "call (206) 555-0100 now") == ["206-555-0100"]
    assert one(spark, names.plain_text, "<b>A&amp;B</b>&nbsp;c") == "A&B c"
    assert one(spark, names.location, "Salem, or").asDict() == {"city": "Salem", "state": "OR"}
    assert one(spark, names.is_extension, "Penn", "Penn State") is True
    assert one(spark, names.is_extension, "Penn", "Penn") is False
    assert names.escape_like("a%_\\") == "a\\%\\_\\\\"


@pytest.mark.parametrize(("cell", "score"), [("3-2", (3, 2)), ("W 3-2", (3, 2)), ("F 1-0", (1, 0)), ("0-0 FF", (0, 0)), ("2-2 (4-3)", (2, 2)), ("", (None, None)), ("2010-2012", (None, None))])
def test_score(spark, cell, score):
    assert tuple(one(spark, classify.score, cell)) == score


def test_classes(spark):
    assert tuple(one(spark, classify.inline_score, "FC 2010-2012 vs X 3-1")) == (3, 1)
    assert one(spark, classify.role_of_title, "Director of Coaching") == "doc"
    assert one(spark, classify.grade, "PK") == -1
    assert one(spark, classify.loose_int, "24pts") == 24
    assert one(spark, classify.role_of_title, "Asst. Coach") == "assistant" and one(spark, classify.role_of_title, "Goalkeeping") == "gk_coach"
    assert one(spark, classify.title_role, " Director of Coaching ") == "club_director" and one(spark, classify.title_role, "Conditioning lead") == "fitness" and one(spark, classify.title_role, None) == "other"
    assert one(spark, classify.failure_kind, "Read timed out") == "timeout" and one(spark, classify.failure_kind, "ERR_INTERNET down") == "network"
    assert one(spark, lambda m, k: classify.failure_kind(m, k), "x", "KeyError") == "parse_error" and one(spark, classify.failure_kind, "0 rows") == "unknown"
    assert one(spark, classify.tier_of_label, "NPL Member League") == "competitive" and one(spark, classify.tier_of_label, "ECNL") is None
    assert one(spark, names.without_suffixes, "Solar Soccer Club Juniors") == "solar" and one(spark, names.without_suffixes, "Inc League FA") == "inc league"
    assert one(spark, lambda h, a, z, t: classify.site_status(h, a, z, t), 200, "https://a.org", "https://a.org", "Coming soon, parked by X") == "dead"
    assert tuple(one(spark, classify.bracket, "G U-14 Premier")) == ("U14", "F")
    assert one(spark, lambda a, b, c: classify.person_hash(a, b, c), "Jo  O'Neil", None, 7) == one(spark, lambda a, b, c: classify.person_hash(a, b, c), "jo o'neil", "", 7)


@pytest.mark.parametrize(("text", "when"), [("2026-03-14 15:30", "2026-03-14 15:30:00"), ("3/14/2026 3:30 PM", "2026-03-14 15:30:00"), ("Sat, Mar 14 2026 3:30 PM", "2026-03-14 15:30:00"), ("Mar 14, 2026", "2026-03-14 00:00:00"), ("soon", None)])
def test_dates(spark, text, when):
    got = one(spark, dates.parse_date, text)
    assert (None if got is None else str(got)) == when


def test_seasons(spark):
    d = lambda f: lambda c: f(c.cast("date"))
    assert one(spark, d(dates.academic_year), "1999-08-01") == "1999-00"
    assert one(spark, d(dates.academic_year), "2024-07-31") == "2023-24"
    assert one(spark, dates.season_of_text, "Fall 2024-25 list") == "2024-25"
    assert one(spark, dates.season_of_text, "Results 2024") == "2023-24"
    assert one(spark, dates.class_year, "RS-Fr.") == "freshman"
    assert one(spark, lambda a, b: dates.grad_year_of_birth_month(a, b), 2008, 8) == 2026
    got = one(spark, dates.date_range, "Jan 2 - Feb 5, 2026")
    assert [str(x) for x in got] == ["2026-01-02", "2026-02-05"]


def test_ratios():
    assert similarity.sorted_ratio("b a", "a b") == 100
    assert similarity.set_ratio("dallas texans", "dallas") == 100
    assert similarity.set_ratio("", "x") == 0
    assert similarity.common_length("kitten", "sitting") == 4
    assert round(similarity.winkler("martha", "marhta"), 4) == 0.9611


def test_guard(spark):
    assert one(spark, similarity.unsafe_subset, "a b c d", "a b") is True
    assert one(spark, similarity.unsafe_subset, "a b c d", "a b c") is False

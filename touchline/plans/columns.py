"""Named queries of the readings of cells: texts made of a table's columns, read back.

Every row of a table renders a text in one of several spellings, by its key; the SQL
twin gives what the text was made of, or what its spelling must give, and repeats no
formula.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import classify, dates, names, similarity
from ..sources import scans
from .catalog import QUERIES, SQL

#: Keys of the tables that are read.
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "lineitem": "l_orderkey", "supplier": "s_suppkey"}
#: Spark's name of a type -> DuckDB's.
KINDS = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def reads(name: str, about: str, table: str, inputs: str, outputs: str, read: Callable[..., list[Column]], spellings: list[tuple]) -> None:
    """Register a query over ``table``.

    A spelling holds the ``inputs`` (DDL) as Spark expressions of the table's columns,
    then the ``outputs`` (DDL) as DuckDB expressions; the row of key ``k`` has spelling
    ``k % len(spellings)``.
    """
    given, made = ([part.split() for part in ddl.split(", ")] for ddl in (inputs, outputs))
    key, n = KEYS[table], len(spellings)
    case = lambda at: f"CASE {key} % {n} " + " ".join(f"WHEN {k} THEN {s[at]}" for k, s in enumerate(spellings)) + " END"

    def run(spark, d):
        frame = scans.table(spark, d, table).select(key, *(F.expr(case(i)).cast(t).alias(f"_{c}") for i, (c, t) in enumerate(given)))
        columns = read(*(F.col(f"_{c}") for c, _ in given))
        return frame.select(key, *(c.cast(t).alias(o) for c, (o, t) in zip(columns, made, strict=True)))

    run.__name__, run.__doc__ = name, about
    QUERIES[name] = run
    SQL[name] = f"SELECT {key}, {', '.join(f'CAST({case(len(given) + i)} AS {KINDS[t]}) AS {o}' for i, (o, t) in enumerate(made))} FROM {table}"


def fields(c: Column, *parts: str) -> list[Column]:
    return [c[p] for p in parts]


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


# --- dates ---------------------------------------------------------------------

_DAY = 'date_format(o_orderdate, "{}")'.format
reads("date_formats", "DT-01", "orders", "cell string", "moment timestamp_ntz", lambda c: [dates.parse_date(c)], [
    (_DAY("yyyy-MM-dd HH:mm"), "o_orderdate"), (_DAY("yyyy-MM-dd'T'HH:mm:ss"), "o_orderdate"), (_DAY("M/d/yyyy h:mm a"), "o_orderdate"), (f"concat('Sat, ', {_DAY('MMM d yyyy h:mm a')})", "o_orderdate"),
    (_DAY("MMM d, yyyy"), "o_orderdate"), (f"concat('on ', {_DAY('yyyy-MM-dd')})", "NULL"), ("NULL", "NULL"), (_DAY("yyyy-02-30"), "NULL"),
])
reads("prior_seasons", "DT-03: as one text", "orders", "first int, n int", "seasons string", lambda y, n: [F.array_join(dates.seasons_back(y, n), ",")], [
    ("year(o_orderdate)", "1", "printf('%d-%02d', year(o_orderdate), (year(o_orderdate) + 1) % 100)"),
    ("year(o_orderdate)", "2", "printf('%d-%02d,%d-%02d', year(o_orderdate), (year(o_orderdate) + 1) % 100, year(o_orderdate) - 1, year(o_orderdate) % 100)"),
])
_LATER = "(year(o_orderdate) + 20)"
_SEASON = f"printf('%d-%02d', {_LATER}, ({_LATER} + 1) % 100)"
reads("season_of_text", "DT-04", "orders", "cell string", "season string", lambda c: [dates.season_of_text(c)], [
    (f"format_string('Fall %d-%02d table', {_LATER}, ({_LATER} + 1) % 100)", _SEASON), (f"format_string('%d–%02d', {_LATER}, ({_LATER} + 1) % 100)", _SEASON), (f"concat('Champions ', {_LATER} + 1)", _SEASON), ("o_orderpriority", "NULL"),
])
reads("grade_year", "DT-07", "orders", "cell string, spring int", "grad_year int", lambda c, s: [dates.grad_year_of_grade(c, s)], [
    ("'Sr.'", _LATER, _LATER), ("'Junior'", _LATER, f"{_LATER} + 1"), ("' 9th '", _LATER, f"{_LATER} + 3"), (f"concat('Class of ', {_LATER} + 2)", "2000", f"{_LATER} + 2"), ("'So'", _LATER, f"{_LATER} + 2"), ("o_orderpriority", _LATER, "NULL"),
])
reads("class_year", "DT-08", "customer", "cell string", "year string", lambda c: [dates.class_year(c)], [("'Fr.'", "'freshman'"), ("'R-So'", "'sophomore'"), ("'rs jr'", "'junior'"), ("'5th Yr.'", "'grad'"), ("c_mktsegment", "NULL"), ("'RS-Fr.'", "'freshman'")])
reads("date_ranges", "DT-13", "orders", "cell string", "first date, last date", lambda c: fields(dates.date_range(c), "first", "last"), [
    (f"concat({_DAY('MMM d')}, ' - ', date_format(o_orderdate + INTERVAL 3 DAYS, 'MMM d'), ', ', year(o_orderdate + INTERVAL 3 DAYS))", "CASE WHEN year(o_orderdate) = year(o_orderdate + INTERVAL 3 DAY) THEN o_orderdate ELSE o_orderdate + INTERVAL 1 YEAR END", "o_orderdate + INTERVAL 3 DAY"),
    ("concat(date_format(o_orderdate, 'MMMM'), ' 2-', 2 + day(o_orderdate) % 20, ', ', year(o_orderdate))", "make_date(year(o_orderdate), month(o_orderdate), 2)", "make_date(year(o_orderdate), month(o_orderdate), 2 + day(o_orderdate) % 20)"),
    (_DAY("MMM d, yyyy"), "o_orderdate", "o_orderdate"), ("o_orderpriority", "NULL", "NULL"),
])
reads("division_age", "DT-14", "orders", "division string, season string", "age string", lambda c, s: [dates.age_of_division(c, s)], [
    (f"concat('G', {_LATER} - 15, '/', {_LATER} - 16)", f"format_string('%d-x', {_LATER})", "'U16'"), (f"concat('b', {_LATER} + 4)", f"format_string('%d-x', {_LATER})", "'U1'"), (f"concat('B', {_LATER} - 10)", f"format_string('%d-x', {_LATER})", "'U11'"), ("o_orderpriority", f"format_string('%d-x', {_LATER})", "NULL"),
])

# --- names, texts, sites -----------------------------------------------------------

reads("club_tokens", "STR-05, with ``|`` between tokens", "part", "cell string", "tokens string", lambda c: [joined(names.tokens(c))], [
    ("concat(initcap(p_name), ' FC')", "replace(p_name, ' ', '|') || '|football'"), ("concat('The ', p_name, ' Utd.')", "replace(p_name, ' ', '|') || '|united'"), ("concat('(', p_name, ') AC')", "replace(p_name, ' ', '|') || '|athletic'"), ("'The Youth Academy'", "''"),
])
reads("college_tokens", "STR-06", "part", "cell string", "tokens string", lambda c: [joined(names.college_tokens(c, ["university", "college", "of", "the"]))], [
    ("concat('University of ', initcap(p_name))", "replace(p_name, ' ', '|')"), ("concat('The (', p_name, ') College')", "replace(p_name, ' ', '|')"), ("'College'", "''"),
])
reads("school_names", "STR-07", "part", "cell string", "name string", lambda c: [names.school_name(c)], [("concat('  ', upper(p_name), '   High-School ')", "p_name || ' high-school'"), ("concat('St. ', initcap(p_name), ' H.S.')", "'st ' || p_name || ' h s'")])
reads("clean_cells", "STR-10", "customer", "cell string", "clean string", lambda c: [names.blank_to_null(c)], [("concat('  ', c_name, ' \\t ', c_mktsegment, ' ')", "c_name || ' ' || c_mktsegment"), ("'   '", "NULL"), ("''", "NULL"), ("c_name", "c_name")])
reads("websites", "STR-11", "customer", "cell string", "site string", lambda c: [names.website(c)], [("concat('HTTPS://www.Club', c_custkey, '.org/')", "'club' || c_custkey || '.org'"), ("concat('http://club', c_custkey, '.org/a/')", "'club' || c_custkey || '.org/a'"), ("'https://'", "NULL")])
reads("accepted_sites", "STR-13", "customer", "cell string", "ok boolean", lambda c: [names.accepted_host(c, ["facebook.com"], [".org", ".com"])], [("concat('https://club', c_custkey, '.org/x')", "true"), ("concat('https://m.facebook.com/club', c_custkey)", "false"), ("concat('club', c_custkey, '.xyz')", "false")])
reads("without_suffix", "STR-14", "part", "cell string", "name string", lambda c: [names.without_suffix(c, ["ECNL RL", "ECNL"])], [("concat(p_name, ' - ECNL')", "p_name"), ("concat(p_name, ' ECNL RL')", "p_name"), ("concat('ECNL ', p_name)", "'ECNL ' || p_name")])
reads("plain_texts", "STR-15", "customer", "cell string", "text string", lambda c: [names.plain_text(c)], [("concat('<b>', c_name, '&amp;B</b>&nbsp;', c_mktsegment)", "c_name || '&B ' || c_mktsegment"), ("concat('<p>', c_name, '</p><p>y</p>')", "c_name || ' y'"), ("concat('&amp;lt;', c_custkey)", "'&lt;' || c_custkey")])
reads("city_and_state", "STR-16", "part", "cell string", "city string, state string", lambda c: fields(names.location(c), "city", "state"), [("concat(initcap(p_name), ', or')", "list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b)", "'OR'"), ("p_name", "p_name", "NULL"), ("''", "NULL", "NULL")])
reads("position_and_name", "STR-16", "part", "cell string", "position string, name string", lambda c: fields(names.position_prefix(c), "position", "name"), [("concat('GK  ', p_brand, ' ', p_size)", "'GK'", "p_brand || ' ' || p_size"), ("concat('D/M Kim ', p_size)", "'D/M'", "'Kim ' || p_size"), ("p_brand", "NULL", "p_brand")])
reads("name_and_trailer", "STR-16", "part", "cell string", "name string, trailer string", lambda c: fields(names.name_and_trailer(c), "name", "trailer"), [("concat(p_brand, '  Lee (', p_name, ')')", "p_brand || ' Lee'", "p_name"), ("concat(p_brand, ' (', p_name, ' (Red))')", "p_brand", "p_name || ' (Red)'"), ("concat(p_brand, ' ()')", "p_brand", "NULL"), ("p_brand", "p_brand", "NULL")])
reads("contacts", "STR-17", "customer", "cell string", "emails string, phones string", lambda c: [joined(names.emails(c)), joined(names.phones(c))], [
    ("concat('write A', c_custkey, '@b.org, a', c_custkey, '@B.org')", "'a' || c_custkey || '@b.org'", "''"), ("format_string('call (206) 555-%04d or 206.555.%04d', c_custkey % 10000, c_custkey % 10000)", "''", "printf('206-555-%04d', c_custkey % 10000)"), ("c_mktsegment", "''", "''"),
])
reads("like_escapes", "STR-19: a literal ``_`` and ``%`` in the pattern", "customer", "cell string", "hit boolean", lambda c: [c.like("%" + names.escape_like("a_b%") + "%")], [("concat(c_name, 'a_b%', c_custkey)", "true"), ("concat(c_name, 'aXb%')", "false"), ("concat('a_bc', c_name)", "false")])
reads("school_states", "STR-20", "part", "cell string", "name string, state string", lambda c: fields(names.state_in_parentheses(c), "name", "state"), [("concat(p_name, '  (Calif.)')", "p_name", "'CA'"), ("concat(p_name, ' (KS)')", "p_name", "'KS'"), ("concat(p_name, ' (New Mexico)')", "p_name", "'NM'"), ("concat(p_name, ' (Narnia)')", "p_name", "NULL"), ("p_name", "p_name", "NULL")])
reads("college_spellings", "STR-20", "part", "cell string", "name string", lambda c: [names.spelled_out(names.college_name(c))], [("concat('St. ', initcap(p_name), ' University')", "'saint ' || p_name"), ("concat('Mt. ', p_name, ' College')", "'mount ' || p_name"), ("concat(p_name, ' Institute')", "p_name")])
reads("name_extensions", "STR-22", "part", "a string, b string", "extends boolean", lambda a, b: [names.is_extension(a, b)], [("p_name", "concat(initcap(p_name), ' State')", "true"), ("concat(p_name, ' state')", "upper(p_name)", "true"), ("p_name", "p_name", "false"), ("p_name", "concat('Old ', p_name)", "false")])

# --- scores ---------------------------------------------------------------------------

reads("search_scores", "SIM-10", "customer", "name_share double, city_share double, in_state boolean, root boolean, keyword boolean", "score int", lambda *c: [similarity.search_score(*c)], [
    ("1.0", "1.0", "true", "true", "c_custkey >= 0", "100"), ("0.5", "0.0", "false", "true", "c_nationkey < 12", "CASE WHEN c_nationkey < 12 THEN 45 ELSE 40 END"), ("(c_custkey % 11) / 10.0", "0.0", "false", "false", "false", "5 * (c_custkey % 11)"),
])
reads("site_confidences", "SIM-11", "customer", "status string, logo boolean, socials int, staff boolean", "confidence int", lambda *c: [similarity.site_confidence(*c)], [
    ("'dead'", "true", "c_nationkey", "true", "10"), ("'active'", "true", "c_nationkey", "true", "60 + 10 * least(c_nationkey, 3)"), ("'active'", "false", "c_nationkey", "false", "20 + 10 * least(c_nationkey, 3)"),
])
reads("path_confidences", "SIM-12", "customer", "path string", "confidence double", lambda c: [similarity.path_confidence(c, ["/coaches", "/staff"], ["/about"])], [("concat('/', c_custkey, '/Staff/list')", "1.0"), ("concat('/about-', c_custkey)", "0.7"), ("concat('/', c_name)", "0.5")])
reads("anchor_scores", "SIM-13", "customer", "hit boolean, label string, both_genders boolean", "score int", lambda h, t, b: [similarity.anchor_score(h, t, "women", "men's", b)], [
    ("true", "concat('Women''s Soccer ', c_custkey)", "c_nationkey = 3", "CASE WHEN c_nationkey = 3 THEN 14 ELSE 15 END"), ("true", "'Men''s Soccer'", "false", "5"), ("false", "concat('Soccer ', c_name)", "true", "1"), ("false", "c_mktsegment", "false", "0"),
])

# --- classes -----------------------------------------------------------------------------

reads("inline_scores", "CLS-02", "customer", "cell string", "home int, away int", lambda c: fields(classify.inline_score(c), "home", "away"), [("concat('FC 2010-2012 vs X ', c_nationkey, '-', c_custkey % 7)", "c_nationkey", "c_custkey % 7"), ("concat('final: ', c_custkey % 9, ' – 2')", "c_custkey % 9", "2"), ("c_mktsegment", "NULL", "NULL")])
reads("brackets", "CLS-05", "part", "cell string", "age_group string, gender string", lambda c: fields(classify.bracket(c), "age_group", "gender"), [
    ("concat('B', 10 + p_size % 9, ' Premier')", "'U' || (10 + p_size % 9)", "'M'"), ("concat('U', 1 + p_size % 9, ' Girls')", "'U0' || (1 + p_size % 9)", "'F'"), ("concat('G U-', 10 + p_size % 9, ' Premier')", "'U' || (10 + p_size % 9)", "'F'"), ("concat(2010 + p_size % 9, ' Boys')", "'' || (2010 + p_size % 9)", "'M'"), ("'Open'", "NULL", "NULL"),
])
reads("tier_labels", "CLS-08", "customer", "cell string", "tier string", lambda c: [classify.tier_of_label(c)], [("'NPL Member League'", "'competitive'"), ("'National Elite'", "'elite'"), ("'Regional Tournament'", "'competitive'"), ("c_mktsegment", "NULL")])
reads("match_classes", "CLS-12", "customer", "score double", "class string", lambda c: [classify.match_class(c)], [("88 + c_custkey % 13", "'DUPLICATE'"), ("75 + c_custkey % 13", "'NEAR_MATCH'"), ("74.9 - c_custkey % 70", "'NET_NEW'")])
reads("failure_kinds", "CLS-13", "customer", "message string, exception string", "kind string", lambda m, k: [classify.failure_kind(m, k)], [
    ("concat('Read timed out ', c_custkey)", "NULL", "'timeout'"), ("concat('ERR_INTERNET down ', c_name)", "NULL", "'network'"), ("c_name", "'KeyError'", "'parse_error'"), ("c_name", "'JSONDecodeError'", "'parse_error'"), ("c_name", "NULL", "'unknown'"), ("NULL", "NULL", "NULL"),
])
reads("site_statuses", "CLS-16", "customer", "http int, first_url string, last_url string, body string", "status string", lambda *c: [classify.site_status(*c)], [
    ("400 + c_nationkey", "'https://a.org'", "'https://a.org'", "''", "'dead'"), ("200", "concat('https://a', c_custkey, '.org')", "'https://b.org/x'", "''", "'redirected'"), ("200", "concat('https://a', c_custkey, '.org')", "concat('https://www.a', c_custkey, '.org/x')", "'Coming soon'", "'active'"), ("200", "'https://a.org'", "'https://a.org'", "concat('Coming soon, parked by ', c_name)", "'dead'"),
])
reads("head_coaches", "CLS-17", "customer", "title string", "head boolean", lambda c: [classify.is_head_coach(c)], [("concat('Head ', c_mktsegment, ' Coach')", "true"), ("concat('Associate Head Coach ', c_custkey)", "false"), ("'Coach'", "false"), ("NULL", "NULL")])
reads("loose_ints", "CLS-18", "customer", "cell string", "n int", lambda c: [classify.loose_int(c)], [("concat(c_custkey, 'pts')", "c_custkey"), ("concat(' -', c_custkey + 1, ' ')", "-(c_custkey + 1)"), ("concat('pts', c_custkey)", "NULL"), ("concat('99999999999', c_custkey)", "NULL")])
reads("grade_spans", "CLS-19", "customer", "low string, high string", "from_grade int, to_grade int, high_school boolean", lambda a, b: [classify.grade(a), classify.grade(b), classify.grades_overlap(classify.grade(a), classify.grade(b))], [
    ("'PK'", "cast(1 + c_nationkey % 12 AS string)", "-1", "1 + c_nationkey % 12", "c_nationkey % 12 >= 8"), ("cast(1 + c_nationkey % 12 AS string)", "'12'", "1 + c_nationkey % 12", "12", "true"), ("NULL", "'09'", "NULL", "9", "true"), ("c_mktsegment", "NULL", "NULL", "NULL", "false"), ("'KG'", "'8'", "0", "8", "false"),
])
reads("player_pools", "CLS-20", "orders", "title string, slug string, posted string, body string", "tier string, selected int, born int", lambda t, s, p, b: [classify.pool_tier(t, s), classify.selection_year(p), classify.birth_year(b, t, classify.selection_year(p))], [
    ("'National Pool named'", "'id2-pool'", _DAY("yyyy-MM-dd'T'HH:mm:ss"), f"concat('players born in ', {_LATER} - 15)", "'national'", "year(o_orderdate)", f"{_LATER} - 15"), ("'Regional Camp'", "'national-team'", _DAY("yyyy-MM-dd"), "concat('the U-', 10 + o_orderkey % 9, ' group')", "'training-center'", "year(o_orderdate)", "year(o_orderdate) - (10 + o_orderkey % 9)"),
    (f"concat('id2 ', {_LATER} - 8)", "'x'", "o_orderpriority", "NULL", "NULL", "NULL", f"{_LATER} - 8"), ("'ID selection'", "'x'", _DAY("yyyy"), "'U30 and born in 1950'", "'regional'", "year(o_orderdate)", "NULL"),
])


def _gate(season, scraped, players, in_review, attempts):
    return fields(classify.scrape_gate(season, "2025-26", scraped.cast("timestamp_ntz"), players, in_review, attempts, "2026-01-31 00:00:00"), "go", "reason")


_BUSY = "o_orderkey % 20"
reads("scrape_gates", "CLS-21", "orders", "season string, scraped string, players int, in_review boolean, attempts int", "go boolean, reason string", _gate, [
    ("'2020-21'", "NULL", _BUSY, "false", "NULL", "false", "'likely_covid_cancelled'"),
    ("'2025-26'", "concat('2026-01-', 10 + o_orderkey % 20, ' 10:00:00')", "0", "true", "9", "false", "'fresh:scraped_at=2026-01-' || (10 + o_orderkey % 20)"),
    ("'2025-26'", _DAY("yyyy-MM-dd HH:mm:ss"), "50", "true", "9", "true", "'ok'"),
    ("'2023-24'", "NULL", _BUSY, "false", "NULL", f"{_BUSY} < 10", f"CASE WHEN {_BUSY} >= 10 THEN 'historical_has_data:count=' || {_BUSY} ELSE 'ok' END"),
    ("'2023-24'", "NULL", "9", "true", _BUSY, "false", "'unresolved_url_needs_review'"),
    ("'2023-24'", "NULL", "0", "false", _BUSY, f"{_BUSY} < 3", f"CASE WHEN {_BUSY} >= 3 THEN 'max_attempts:' || {_BUSY} ELSE 'ok' END"),
])
reads("scrape_gates_forced", "CLS-21: a forced season", "orders", "season string, players int", "go boolean, reason string", lambda s, n: fields(classify.scrape_gate(s, "2025-26", F.lit(None).cast("timestamp_ntz"), n, F.lit(True), F.lit(9), "2026-01-31 00:00:00", force_season="2020-21"), "go", "reason"), [
    ("'2020-21'", _BUSY, "true", "'force_historical'"), ("'2023-24'", f"10 + {_BUSY}", "false", f"'historical_has_data:count=' || (10 + {_BUSY})"),
])

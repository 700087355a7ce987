"""Replay, schedule tables and the growing master on small odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.functions import dates, names, similarity
from touchline.operators import entity, fuzzy
from touchline.sources import replays, schedules


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_replay_keeps_errors_apart(spark):
    registry = replays.Registry()

    @registry.register(r"example\.org/one")
    def one(html, url):
        yield {"name": html.upper(), "n": len(html)}
        if html == "bad":
            raise KeyError("late")

    @registry.register(r"example\.org", name="all")
    def other(html, url):
        return [{"name": w} for w in html.split()]

    @registry.register(r"fetch", replayable=False)
    def fetched(html, url):
        raise AssertionError

    pages = spark.createDataFrame([(1, "http://EXAMPLE.org/one", "ab"), (2, "http://example.org/one", "bad"), (3, "http://example.org/two", "x y"), (4, "http://fetch", "z"), (5, None, "z"), (6, "http://example.org", None), (None, "http://example.org/one", "")], "page_id long, url string, html string")
    got, errors = replays.replay(pages, registry, ["name", "n"])
    assert rows(got) == sorted([(1, "one", 0, "AB", "2"), (3, "all", 0, "x", None), (3, "all", 1, "y", None), (None, "one", 0, "", "0")], key=repr)
    assert rows(errors) == [(2, "one", "KeyError: 'late'")]
    assert rows(replays.summary(pages, registry, got, errors)) == [("all", "replayed", 2, 2, 0), ("fetched", "not replayable", 1, 0, 0), ("one", "replayed", 3, 2, 1), ("unmatched", "no parser", 1, 0, 0)]
    with pytest.raises(Exception, match="constant"):
        pages.lateralJoin(replays.page_parser({})(F.lit("one"), F.col("url").outer(), F.col("html").outer(), F.col("url").outer())).collect()


def test_header_columns():
    assert schedules.columns_of(["match #", "date/time", "home team", "results", "away team", "location", "division"]) == {"match_num": 0, "datetime": 1, "home": 2, "score": 3, "away": 4, "division": 6}
    assert schedules.columns_of(["", "home", "away", "home score"]) == {"home": 1, "away": 2, "score": 3}


def test_schedules(spark):
    head = "<tr><th>Match #</th><th>Time</th><th>Home Team</th><th>Results</th><th>Away Team</th><th>Location</th><th>Bracket</th></tr>"
    named = f"""<table>{head}
      <tr><td>1</td><td>Feb 14, 2026<br>9:15 AM CST</td><td>Solar <b>SC</b></td><td>2 - 1</td><td>Rush</td><td>F1</td><td>B15 Premier</td></tr>
      <tr><td>2</td><td>Mar 07, 2026<br>1:00 PM CST<br><br>Canceled</td><td>Solar SC</td><td>-</td><td>Rush</td><td>F1</td><td>U9 Girls</td></tr>
      <tr><td>3</td><td>Mar 07, 2026</td><td>BYE</td><td></td><td>Rush</td></tr><tr><td>4</td><td></td><td></td><td></td><td>Rush</td></tr><tr><td>short</td></tr>
      <tr><td>Mar 09, 2026</td><td></td><td></td><td></td><td></td></tr><tr><td>5</td><td></td><td>A Team</td><td>W 3-0</td><td>B Team</td></tr></table>"""
    bare = """<table><tr><td>x</td></tr><tr><td colspan=3>3/1/2026</td></tr><tr><td>North</td><td>1 - 0</td><td>South</td></tr><tr><td>East</td><td>vs</td><td>West</td></tr>
      <tr><td>3/2/2026</td></tr><tr><td>North</td><td>F 1-0</td><td>West</td></tr></table><table><tr><td>no</td><td>schedule</td></tr></table>"""
    pages = spark.createDataFrame([(1, named), (2, bare), (3, None), (4, "<table><tr><th>home</th><th>away</th></tr>"), (5, "no table")], "k int, html string").withColumn("home", F.lit("x"))
    got = {(r.k, r.row_no): (r.strategy, r.home, r.away, r.home_score, r.away_score, str(r.match_date), r.status, r.age_group, r.gender) for r in schedules.schedule(pages, "k", "html").collect()}
    assert got == {
        (1, 1): ("header", "Solar SC", "Rush", 2, 1, "2026-02-14 09:15:00", "final", "U15", "M"),
        (1, 2): ("header", "Solar SC", "Rush", None, None, "2026-03-07 13:00:00", "cancelled", "U09", "F"),
        (1, 7): ("header", "A Team", "B Team", None, None, "2026-03-09 00:00:00", "scheduled", None, None),
        (2, 2): ("score", "North", "South", 1, 0, "2026-03-01 00:00:00", "final", None, None),
        (2, 3): ("score", "East", "West", None, None, "2026-03-01 00:00:00", "scheduled", None, None),
        (2, 5): ("score", "North", "West", 1, 0, "2026-03-02 00:00:00", "forfeit", None, None),
    }


def test_plain_pages_are_read_as_the_parser_reads_them():
    """Pages of plain tags never reach the parser, whose steps are most of the work; all others do."""
    rnd = random.Random(5)
    bits = ["<table>", "</table>", "<TR>", "</tr>", "<td>", "</td>", "<th>", "</th >", '<td colspan="3">', "<td colspan=3>", "<td a=1b>", "<br>", "<br/>", "<b", ">", "<", "&amp;", "<!-- x -->", "<script>", "x", "a  b", "\n", " 2 - 1 ", "\xa0", '<tr class="a b">', "<tdx>", "</>", '<table x="<td>">', '</td a="1">']
    quick = 0
    for _ in range(20_000):
        page = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 12)))
        found = schedules._quick(page)
        if found is not None:
            quick += 1
            reader = schedules._Cells()
            reader.feed(page)
            assert found == reader.tables, page
    assert quick > 500
    assert schedules._quick("<table><tr><td>a &amp; b</td></tr></table>") is None
    assert schedules._tables("<table><tr><td>a &amp; b</td></tr></table>") == [[[(False, ["a & b"])]]]


def test_only_formats_that_fit_are_tried(spark):
    """The result is that of trying all of them."""
    cells = ["2024-01-02 03:04:05", "2024-01-02 03:04", "2024-01-02T03:04:05", "2024-01-02", "1/2/2024 3:04 PM", "1/2/2024 13:04", "1/2/2024", "Jan 2 2024 3:04 AM", "Jan 2, 2024 3:04 AM", "Sat, Jan 2, 2024", "Tue, 2024-01-02", "Jan 2 2024", "2024/01/02", "x", "", None, "12:30", "1/2/2024, 3:04 PM", "+12024-01-02", "2024-01-02T03:04:05Z"]
    frame = spark.createDataFrame([(x,) for x in cells], "c string")
    text = F.trim(F.regexp_replace(F.regexp_replace("c", r"\s+", " "), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,\s*", ""))
    plain = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in dates.FORMATS)).cast("timestamp_ntz")
    got = frame.select("c", dates.parse_date(F.col("c")).cast("string").alias("got"), plain.cast("string").alias("want")).collect()
    assert [(r.c, r.got) for r in got] == [(r.c, r.want) for r in got]
    assert sum(r.got is not None for r in got) >= 11


def test_names_that_stay(spark):
    texts = ["Solar SC", "boys", "Boys Gold", "\tBoys", "Bo(x)ys", "(x)", "(x) y", "", " ", None, "U15", "U15 Rush", "-Boys", "Boysen", "boys-", "Club (a", "é", *names.DESCRIPTORS]
    frame = spark.createDataFrame([(x,) for x in texts], "c string")
    got = frame.select("c", names.has_canonical_name(F.col("c")).alias("got"), (names.canonical_name(F.col("c")) != "").alias("want")).collect()
    assert [(r.c, r.got) for r in got] == [(r.c, r.want) for r in got]


def whole_frame(data, least=88):
    """The last row of each key, then each row that is alike to an earlier one that stays goes."""
    last = {}
    for row in sorted(data):
        last[row[1:3]] = row
    kept = []
    for row in sorted(last.values()):
        if not any(row[3] == k[3] or similarity.sorted_ratio(row[3], k[3]) >= least for k in kept):
            kept.append(row)
    return kept


def test_master_grows_as_the_whole_frame_rule_says(spark, monkeypatch):
    rnd = random.Random(8)
    base = ["solar north stars", "crossfire premier", "beach city", "rush", ""]
    schema = "id long, club string, league string, name string"
    def batch(first, n):
        out = []
        for i in range(first, first + n):
            s = list(rnd.choice(base))
            for _ in range(rnd.randrange(4) if s else 0):
                s[rnd.randrange(len(s))] = rnd.choice("abcde ")
            name = " ".join("".join(s).split())
            out.append((i, name if rnd.random() < 0.8 else f"club {rnd.randrange(5)}", rnd.choice(["x", "y", None]), name))
        return out
    data = batch(0, 40)
    kept = whole_frame(data)
    master = spark.createDataFrame(kept, schema)
    index = entity.master_index(master, "id", "name")
    probed = []
    probe = fuzzy.probe_pieces
    monkeypatch.setattr(fuzzy, "probe_pieces", lambda i, df, *a, **k: probed.append(df.count()) or probe(i, df, *a, **k))
    for turn in (1, 2, 3):
        new = batch(turn * 100, 15)
        master, index = entity.append_to_master(master, index, spark.createDataFrame(new, schema), ["club", "league"], "id", "name")
        kept = whole_frame([*kept, *new])
        assert rows(master) == sorted(kept, key=repr)
    assert max(probed) <= 15
    assert entity.append_to_master(master, index, spark.createDataFrame([], schema), ["club", "league"], "id", "name")[0].count() == len(kept)

"""Named queries of page parsers: replay through a registry, schedule tables, the growing master."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import names
from ..operators import entity
from ..sources import replays, scans, schedules
from . import bindings as b
from .catalog import query

T = scans.table

REGISTRY = replays.Registry()


@REGISTRY.register(r"/en/")
def titles(html: str, url: str):
    yield from ({"kind": "title", "value": m} for m in re.findall(r"(?is)<title[^>]*>(.*?)</title>", html))


@REGISTRY.register(r"/fr/")
def anchors(html: str, url: str):
    yield from ({"kind": "link", "value": m} for m in re.findall(r"""(?i)<a\s[^>]*href=["']([^"']*)["']""", html))


@REGISTRY.register(r"/de/")
def headings(html: str, url: str):
    """Pages of ``www`` hosts are laid out in a way that this parser does not know."""
    if "//www." in url:
        raise ValueError("unknown layout")
    yield from ({"kind": "heading", "value": m} for m in re.findall(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", html))


@REGISTRY.register(r"/es/[0-9]*[02468]\b", replayable=False)
def fetching(html: str, url: str):
    raise NotImplementedError


def _replayed(spark, d):
    pages = T(spark, d, "pages")
    return pages, *replays.replay(pages, REGISTRY, ["kind", "value"])


_PICKED = r"""p AS (SELECT *, CASE WHEN regexp_matches(lower(url), '/en/') THEN 'titles' WHEN regexp_matches(lower(url), '/fr/') THEN 'anchors' WHEN regexp_matches(lower(url), '/de/') THEN 'headings'
    WHEN regexp_matches(lower(url), '/es/[0-9]*[02468]\b') THEN 'fetching' ELSE 'unmatched' END AS parser FROM pages),
v AS (SELECT page_id, parser, CASE parser WHEN 'titles' THEN 'title' WHEN 'anchors' THEN 'link' ELSE 'heading' END AS kind,
    CASE parser WHEN 'titles' THEN regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title>', 1) WHEN 'anchors' THEN regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"'']*)["'']', 1)
    WHEN 'headings' THEN CASE WHEN url NOT LIKE '%//www.%' THEN regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1) ELSE [] END ELSE [] END AS l FROM p),
r AS (SELECT page_id, parser, CAST(unnest(range(len(l))) AS INTEGER) AS row_no, kind, unnest(l) AS value FROM v)"""


@query(f"WITH {_PICKED} SELECT * FROM r")
def replayed_rows(spark, d):
    """S-17, UDF-03: rows of all pages by the parser that their URL picks."""
    return _replayed(spark, d)[1]


@query(f"WITH {_PICKED} SELECT page_id, parser, 'ValueError: unknown layout' AS error FROM p WHERE parser = 'headings' AND url LIKE '%//www.%'")
def replay_errors(spark, d):
    """S-17: pages whose parser failed."""
    return _replayed(spark, d)[2]


@query(f"""WITH {_PICKED} SELECT p.parser, CASE p.parser WHEN 'unmatched' THEN 'no parser' WHEN 'fetching' THEN 'not replayable' ELSE 'replayed' END AS outcome, count(*) AS pages,
    (SELECT count(*) FROM r WHERE r.parser = p.parser) AS rows, count(*) FILTER (WHERE p.parser = 'headings' AND url LIKE '%//www.%') AS errors FROM p GROUP BY p.parser""")
def replay_summary(spark, d):
    """S-17, UDF-04: counters of each parser."""
    pages, rows, errors = _replayed(spark, d)
    return replays.summary(pages, REGISTRY, rows, errors)


_TEAMS = "'Club ' || home_club_id || ' FC' AS home, 'Club ' || away_club_id || ' United' AS away"


@query(f"""WITH {b.MATCHES}, m AS (SELECT *, (id // 1000) % 2 = 0 AS named FROM matches WHERE away_club_id IS NOT NULL)
SELECT id // 1000 AS page, CASE WHEN named THEN CAST(id AS VARCHAR) END AS match_num, {_TEAMS}, CAST(CASE WHEN away_score IS NOT NULL THEN home_score END AS INTEGER) AS home_score, CAST(away_score AS INTEGER) AS away_score,
    match_date + INTERVAL 1 HOUR * (CASE WHEN named THEN 9 + id % 3 ELSE 0 END) AS match_date,
    CASE WHEN named AND status = 'postponed' THEN 'postponed' WHEN away_score IS NOT NULL THEN 'final' ELSE 'scheduled' END AS status,
    CASE WHEN named THEN 'U' || (10 + id % 8) END AS age_group, CASE WHEN named THEN gender END AS gender FROM m""")
def schedule_pages(spark, d):
    """S-10: schedule pages made of the matches, half with named columns, half with dates above the rows, read back.

    A page holds the matches of a hundred orders; matches without an away club are byes.
    """
    m = b.matches(spark, d).withColumn("page", F.floor(F.col("id") / 1000)).withColumn("named", F.col("page") % 2 == 0)
    td = lambda *c: F.concat(F.lit("<td>"), *c, F.lit("</td>"))
    text = lambda s: F.lit(s)
    home = F.concat(F.lit("Club "), F.col("home_club_id").cast("string"), F.lit(" FC"))
    away = F.coalesce(F.concat(F.lit("Club "), F.col("away_club_id").cast("string"), F.lit("\n  United")), F.lit("BYE"))
    score = F.coalesce(F.concat(F.col("home_score").cast("string"), F.lit(" - "), F.col("away_score").cast("string")), F.lit("-"))
    day = F.date_format("match_date", "MMM dd, yyyy")
    tag = F.when(F.col("status") == "postponed", "<br><br>Postponed").otherwise("")
    when = F.concat(day, F.lit("<br>"), (9 + F.col("id") % 3).cast("string"), F.lit(":00 AM CST"), tag)
    division = F.concat(F.lit("U"), (10 + F.col("id") % 8).cast("string"), F.when(F.col("gender") == "M", " Boys").otherwise(" Girls"))
    row = F.when(F.col("named"), F.concat(text("<tr>"), td(F.col("id").cast("string")), td(when), td(home), td(score), td(away), td(division), text("</tr>"))).otherwise(
        F.concat(text('<tr><td colspan="3">'), day, text("</td></tr><tr>"), td(home), td(score), td(away), text("</tr>")))
    head = F.when(F.first("named"), "<tr><th>Match #</th><th>Time</th><th>Home Team</th><th>Results</th><th>Away Team</th><th>Division</th></tr>").otherwise("")
    pages = m.groupBy("page").agg(F.concat(F.lit("<html><body><p>Schedule</p><table>"), head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", row.alias("row")))), lambda x: x["row"]), ""), F.lit("</table></body></html>")).alias("html"))
    return schedules.schedule(pages, "page", "html").select("page", "match_num", "home", "away", "home_score", "away_score", "match_date", "status", "age_group", "gender")


@query()
def master_appended(spark, d):
    """ER-03: a master of the first half of the team names, and the other half appended in two runs."""
    t = b.team_names(spark, d).select("id", F.col("raw").alias("club_name"), F.col("state").alias("league_name"), names.canonical_name(F.col("raw")).alias("canonical_name"))
    cut = t.withColumn("_q", F.pmod(F.xxhash64("club_name"), F.lit(4)))
    first = cut.where("_q < 2").drop("_q")
    master = entity.greedy_dedup(entity.keep_last(first, [F.col("club_name"), F.col("league_name")], [F.col("id").desc()]), "id", "canonical_name")
    index = entity.master_index(master, "id", "canonical_name")
    for q in (2, 3):
        new = cut.where(F.col("_q") == q).drop("_q").withColumn("id", F.col("id") + q * (1 << 40))
        master, index = entity.append_to_master(master, index, new, ["club_name", "league_name"], "id", "canonical_name")
    return master

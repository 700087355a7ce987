"""Classification of cells: scores, statuses, roles, tiers, health, platforms; hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import apex_domain, person_name

# Fixed values.
SCORE = r"(?i)^\s*(?:[WLDTF]\s+)?(\d{1,2})\s*[-–:]\s*(\d{1,2})(?:\s*\((\d{1,2})\s*[-–:]\s*(\d{1,2})\))?(?:\s+FF|\s+F)?\s*$"
INLINE_SCORE = r"(?<!\d)(\d{1,2})\s*[-–]\s*(\d{1,2})(?!\d)"


def score(c: Column) -> Column:
    """CLS-01: home and away; a shoot-out is dropped; no score is null."""
    part = lambda k: F.nullif(F.regexp_extract(c, SCORE, k), F.lit("")).try_cast("int")
    return F.struct(part(1).alias("home"), part(2).alias("away"))


def inline_score(c: Column) -> Column:
    """CLS-02: a score inside other text, not part of a longer number."""
    part = lambda k: F.nullif(F.regexp_extract(c, INLINE_SCORE, k), F.lit("")).try_cast("int")
    return F.struct(part(1).alias("home"), part(2).alias("away"))


def match_status(c: Column, home: Column, away: Column) -> Column:
    """CLS-03."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(text.rlike(r"\b(ff|forfeit)\b|^\s*f\s+[0-9]"), "forfeit").when(text.rlike("cancel"), "cancelled").when(text.rlike("postpone|ppd"), "postponed")
        .when(home.isNotNull() & away.isNotNull(), "final").otherwise("scheduled")
    )


def result(own: Column, other: Column) -> Column:
    """CLS-04: W, L or T; null without both scores."""
    return F.when(own > other, "W").when(own < other, "L").when(own == other, "T")


def bracket(c: Column) -> Column:
    """CLS-05: age group and gender of ``B15 Premier``, ``U9 Girls``, ``G U-14``, ``2010 Girls`` and the like."""
    part = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    age = F.concat(F.lit("U"), F.lpad(F.coalesce(part(r"(?i)\b[BG](\d{2})\b"), part(r"(?i)\bU-?(\d{1,2})\b")), 2, "0"))
    gender = F.when(c.rlike(r"(?i)\b(girls?|women|female)\b|\bG\s?U?-?[0-9]|[0-9]G\b"), "F").when(c.rlike(r"(?i)\b(boys?|men|male)\b|\bB\s?U?-?[0-9]|[0-9]B\b"), "M")
    return F.struct(F.coalesce(age, part(r"\b(20[0-2][0-9])")).alias("age_group"), gender.alias("gender"))


# Roles of whole titles, and parts of titles of which the first match wins.
TITLE_ROLES = {
    "head coach": "head_coach",
    "head_coach": "head_coach",
    "assistant coach": "assistant",
    "assistant": "assistant",
    "asst coach": "assistant",
    "goalkeeper coach": "gk_coach",
    "gk coach": "gk_coach",
    "director of coaching": "club_director",
    "doc": "doc",
    "fitness": "fitness",
    "fitness coach": "fitness",
}
TITLE_PARTS = [("head", "head_coach"), ("assistant", "assistant"), ("asst", "assistant"), ("director", "doc"), ("doc", "doc"), ("goalkeep", "gk_coach"), ("gk", "gk_coach"), ("fitness", "fitness"), ("strength", "fitness"), ("conditioning", "fitness")]
ROLES = [("%head%", "head_coach"), ("%assistant%", "assistant"), ("%asst%", "assistant"), ("%director%", "doc"), ("doc", "doc"), ("%goalkeep%", "gk_coach"), ("%gk%", "gk_coach"), ("%fitness%", "fitness"), ("%strength%", "fitness")]


def title_role(c: Column) -> Column:
    """CLS-06: the role of the whole title, or of the first part that it holds; none is ``other``."""
    title = F.lower(F.trim(c))
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in TITLE_ROLES.items() for x in pair)), title)
    part = reduce(lambda out, p: out.when(F.contains(title, F.lit(p[0])), p[1]), TITLE_PARTS[1:], F.when(F.contains(title, F.lit(TITLE_PARTS[0][0])), TITLE_PARTS[0][1]))
    return F.coalesce(known, part, F.lit("other"))


def role_of_title(c: Column) -> Column:
    """CLS-07: the first pattern that the title is like."""
    out = None
    for pattern, role in ROLES:
        hit = F.lower(c).like(pattern)
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("other")


# Fixed values.
TIERS = {
    "National Elite": "elite",
    "National Elite / High National": "elite",
    "National Elite / Pro Pathway": "elite",
    "National / Regional High Performance": "elite",
    "Pre-Elite Development": "elite",
    "NPL Member League": "competitive",
    "Regional Power League": "competitive",
    "Regional Tournament": "competitive",
    "State Association / League Hub": "competitive",
}


def tier_of_label(c: Column, table: dict[str, str] = TIERS) -> Column:
    """CLS-08: unknown labels are null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)


def final_tier(professional: Column, best: Column) -> Column:
    """CLS-09: academies of professional clubs first, then by the best tier number."""
    return F.when(professional, "academy").when(best == 1, "elite").when(best == 2, "competitive").when(best.isNotNull(), "recreational_plus")


# Days until stale, and hours of the service level, by entity.
STALE_DAYS = {"club": 90, "coach": 30, "tryout": 7, "event": 14}
SLA_HOURS = {"club": 168, "league": 720, "college": 168, "coach": 168, "event": 24, "match": 24, "tryout": 168}
OTHER_SLA_HOURS = 168
STREAK = 3


def health_status(scraped: Column, success: Column, failures: Column, entity: Column, as_of: str) -> Column:
    """CLS-10: never, failed, ok or stale."""
    days = F.try_element_at(F.create_map(*(F.lit(x) for pair in STALE_DAYS.items() for x in pair)), entity)
    now = F.lit(as_of).cast("timestamp_ntz")
    return F.when(scraped.isNull(), "never").when(failures >= STREAK, "failed").when(success.isNull(), "failed").when(success >= now - F.make_interval(days=days), "ok").otherwise("stale")


def sla_status(status: Column, scraped: Column, entity: Column, as_of: str) -> Column:
    """CLS-11: ``ok`` becomes ``stale`` beyond the hours of the service level."""
    hours = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SLA_HOURS.items() for x in pair)), entity), F.lit(OTHER_SLA_HOURS))
    late = scraped < F.lit(as_of).cast("timestamp_ntz") - F.make_interval(hours=hours)
    return F.when((status == "ok") & late, "stale").otherwise(status)


def match_class(similarity: Column) -> Column:
    """CLS-12."""
    return F.when(similarity >= 88, "DUPLICATE").when(similarity >= 75, "NEAR_MATCH").otherwise("NET_NEW")


def _any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(w)) for w in words))


# What marks a kind of failure, in the message or the exception's type.
TIMEOUT_MARKS = ["timeout", "timed out", "timeouterror"]
NETWORK_MARKS = ["connectionerror", "connection", "network", "dns", "err_name_not_resolved", "err_connection", "err_internet", "transient"]
PARSE_MARKS = ["beautifulsoup", "parseerror", "parse", "valueerror", "keyerror", "attributeerror", "indexerror"]
#: Types that are a ValueError, KeyError, AttributeError or IndexError without its name.
PARSE_TYPES = ["jsondecodeerror", "unicodeerror", "unicodedecodeerror", "unicodeencodeerror", "unicodetranslateerror", "frozeninstanceerror"]


def failure_kind(message: Column, kind: Column | None = None) -> Column:
    """CLS-13, by the message and the exception's type name; without either null."""
    said = F.concat_ws("\n", message, kind) if kind is not None else message
    given = message.isNotNull() if kind is None else message.isNotNull() | kind.isNotNull()
    by_type = F.coalesce(F.lower(F.element_at(F.split(kind, r"\."), -1)).isin(PARSE_TYPES), F.lit(False)) if kind is not None else F.lit(False)
    return F.when(~given, None).when(_any(said, TIMEOUT_MARKS), "timeout").when(_any(said, NETWORK_MARKS), "network").when(by_type | _any(said, PARSE_MARKS), "parse_error").otherwise("unknown")


def first_match(c: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """CLS-14: the name of the first regular expression that matches."""
    out = None
    for pattern, name in rules:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(otherwise)


def platform(url: Column, html: Column) -> Column:
    """CLS-15: the family of a site: its address first, then generator, body class, scripts and links."""
    address, page = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(html, F.lit("")))
    tag = r"<meta\b[^>]*\bname\s*=\s*[\"'][^\"']*generator[^\"']*[\"'][^>]*>"
    generator = F.regexp_extract(F.regexp_extract(page, tag, 0), r"\bcontent\s*=\s*[\"']([^\"']*)", 1)
    body = F.regexp_extract(page, r"<body\b[^>]*\bclass\s*=\s*[\"']([^\"']*)", 1)
    return (
        F.when(address.contains("sportsengine.com"), "sportsengine").when(address.contains("leagueapps.com"), "leagueapps")
        .when(generator.contains("sportsengine") | body.rlike("se-|sports-engine|sportsengine"), "sportsengine")
        .when(page.rlike(r"<script\b[^>]*\bsrc\s*=\s*[\"'][^\"']*leagueapps|<link\b[^>]*\bhref\s*=\s*[\"'][^\"']*leagueapps"), "leagueapps")
        .when(generator.contains("wordpress") | page.rlike(r"\b(?:href|src)\s*=\s*[\"'][^\"']*/wp-content/"), "wordpress").otherwise("unknown")
    )


# Phrases of parked pages.
PARKED = [
    "this domain is for sale",
    "domain parking",
    "buy this domain",
    "this webpage is parked",
    "domain has expired",
    "website is under construction",
    "coming soon",
    "parked by",
    "godaddy",
    "hugedomains.com",
    "sedoparking",
    "undeveloped.com",
]


def site_status(http: Column, first_url: Column, last_url: Column, body: Column) -> Column:
    """CLS-16."""
    parked = reduce(lambda a, b: a + b, (F.contains(F.lower(body), F.lit(p)).cast("int") for p in PARKED))
    return F.when(http >= 400, "dead").when(apex_domain(first_url) != apex_domain(last_url), "redirected").when(parked >= 2, "dead").otherwise("active")


def is_head_coach(title: Column) -> Column:
    """CLS-17."""
    return title.rlike(r"(?i)\bhead\b.*\bcoach\b") & ~title.rlike(r"(?i)\b(assistant|associate|volunteer|former)\b")


def loose_int(c: Column) -> Column:
    """CLS-18: the number that the text begins with."""
    return F.nullif(F.regexp_extract(F.trim(c), r"^(-?\d+)", 1), F.lit("")).try_cast("int")


def grade(c: Column) -> Column:
    """CLS-19: PK is -1, KG is 0."""
    text = F.upper(F.trim(c))
    return F.when(text == "PK", -1).when(text == "KG", 0).when(text.rlike("^[0-9]{1,2}$"), text.try_cast("int"))


def grades_overlap(low: Column, high: Column, first: int = 9, last: int = 12) -> Column:
    """CLS-19: a span with one side missing counts by the other."""
    return F.when(low.isNull() & high.isNull(), False).otherwise(F.coalesce(low <= last, F.lit(True)) & F.coalesce(high >= first, F.lit(True)))


# Tiers of player pools, and what gives a birth year, in order.
POOL_TIERS = {
    "training-center": ["training camp", "training center", "regional camp", "regional training"],
    "national": ["national pool", "national selection", "national team"],
    "regional": ["regional pool", "regional selection", "regional event", "selection event", "id selection"],
}
BIRTH_YEARS = [
    r"(?i)born in\s+((?:19|20)\d{2})",
    r"(?i)((?:19|20)\d{2})\s+age group",
    r"(?i)((?:19|20)\d{2})\s+(?:boys|girls|standouts|cohort|class)\b",
    r"(?i)\bid2\s+((?:19|20)\d{2})\b",
]


def pool_tier(title: Column, slug: Column) -> Column:
    """CLS-20: the first tier with a phrase in title or slug, or null."""
    text = F.concat_ws(" ", title, slug)
    return reduce(lambda out, t: out.when(_any(text, t[1]), t[0]), POOL_TIERS.items(), F.when(F.lit(False), F.lit(None).cast("string")))


def selection_year(posted: Column) -> Column:
    """CLS-20: the year that a date's text begins with."""
    return F.nullif(F.regexp_extract(posted, r"^((?:19|20)\d{2})", 1), F.lit("")).try_cast("int")


def birth_year(body: Column, title: Column, selected: Column) -> Column:
    """CLS-20: a year from 1990 to 2030 said outright; else ``selected`` less the age of ``U15`` (8 to 23)."""
    text = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    number = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")
    said = [F.when(number(p).between(1990, 2030), number(p)) for p in BIRTH_YEARS]
    age = number(r"\bU-?(\d{1,2})\b")
    return F.coalesce(*said, F.when(age.between(8, 23), selected - age))


# Fixed values.
CANCELLED_SEASONS = ["2020-21"]
ENOUGH_PLAYERS = 10
MOST_ATTEMPTS = 3


def scrape_gate(season: Column, current: str, scraped: Column, players: Column, in_review: Column, attempts: Column, as_of: str, fresh_days: int = 30, force: bool = False, force_season: str | None = None) -> Column:
    """CLS-21: the reason by the first of the ordered rules that holds, and whether to go (``go, reason``).

    ``players``: rows known for the season; ``in_review``: an open flag on its URL;
    ``attempts``: failed ones on record (null: none).
    """
    now_on = season == current
    fresh = scraped > F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(fresh_days))
    reason = (
        F.when(F.lit(force), "force_rescrape").when(season == F.lit(force_season), "force_historical")
        .when(season.isin(CANCELLED_SEASONS), "likely_covid_cancelled")
        .when(now_on & fresh, F.concat(F.lit("fresh:scraped_at="), F.date_format(scraped, "yyyy-MM-dd")))
        .when(now_on, "ok")
        .when(players >= ENOUGH_PLAYERS, F.concat(F.lit("historical_has_data:count="), players.cast("string")))
        .when(in_review, "unresolved_url_needs_review")
        .when(attempts >= MOST_ATTEMPTS, F.concat(F.lit("max_attempts:"), attempts.cast("string")))
        .otherwise("ok")
    )
    return F.struct(reason.isin("force_rescrape", "force_historical", "ok").alias("go"), reason.alias("reason"))


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """CLS-22."""
    return F.least(a, b), F.greatest(a, b)


def person_hash(name: Column, email: Column, club: Column) -> Column:
    """HSH-01."""
    mail = F.nullif(F.lower(F.trim(email)), F.lit(""))
    tail = F.when(mail.isNotNull(), mail).when(club.isNotNull(), F.concat(F.lit("no-email|"), club.cast("string"))).otherwise("no-email")
    return F.sha2(F.concat(person_name(name), F.lit("|"), tail), 256)


def content_hash(text: Column) -> Column:
    """HSH-02."""
    return F.sha2(text, 256)

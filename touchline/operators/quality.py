"""Data quality (DQ-*): detectors and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import grouped_casefold

# Labels of site navigation that leak into names.
NAV_WORDS = [
    "home", "about", "about us", "contact", "contact us", "news", "events", "calendar", "teams", "coaches", "staff", "roster", "rosters",
    "schedule", "schedules", "standings", "results", "tryouts", "register", "registration", "login", "sign in", "sign up", "subscribe", "donate",
    "shop", "store", "sponsors", "partners", "gallery", "photos", "videos", "media", "facilities", "programs", "camps", "clinics", "faq", "sitemap",
]
# Texts of page furniture by category.
UI_FRAGMENTS = {
    "nav_label": [
        "Contact Us", "Corporate Info", "Corporate Sponsors", "Get In Touch", "Important Links", "Nearby Communities", "National Edition",
        "Privacy Preference Center", "Privacy Preferences", "State Edition", "Where We Are",
    ],
    "marketing_tile": [
        "Add commentCancel reply", "Balance, Quickness and Agility", "Book a Trial", "Championship For The Community", "City skyline", "Fashion Magazine",
        "Get real feedback", "SKV Sporting Stripes", "Slide title", "Storm for Nike", "Technical Ball Mastery", "Video of the Day", "Watch them Grow",
    ],
    "pricing_or_date": ["Camp Dates", "Four Week", "Important Dates", "One Week", "Six Week", "Three Weeks", "Two Weeks"],
    "section_heading": [
        "DME Sarasota", "Equipment Needed", "For First Time Coaches", "More Than a Mom", "NM Rapids SC Overview", "Oasis for the Senses",
        "Premier ID Sessions", "Premier Tryouts",
    ],
}
# Phrases that are no names, and words that no name holds.
BLOCKED_PHRASES = [
    "about us", "contact us", "click here", "read more", "learn more", "meet the", "meet our", "our staff", "our team", "coaching staff",
    "support staff", "athletic staff", "staff directory", "head coach", "assistant coach", "associate head", "associate coach", "volunteer coach",
    "graduate assistant", "director of coaching", "director of operations", "athletic director", "technical director", "club director",
    "club president", "executive director", "men soccer", "women soccer", "mens soccer", "womens soccer", "soccer coaches", "coaching team",
    "soccer team", "social media", "quick links", "campus map", "office hours", "follow us", "connect with", "stay connected", "more information",
    "sign up", "log in", "new member", "member login",
]
BLOCKED_WORDS = [
    "soccer", "football", "basketball", "baseball", "softball", "volleyball", "lacrosse", "swimming", "tennis", "golf", "track", "wrestling",
    "coach", "coaching", "staff", "director", "athletic", "athletics", "university", "college", "school", "program", "department", "club",
    "email", "phone", "fax", "office", "contact", "bio", "schedule", "roster", "recruiting", "camps", "news", "media",
    "facebook", "twitter", "instagram", "youtube", "tiktok", "home", "about", "menu", "search", "login", "signup", "register",
    "calendar", "events", "tournament", "league", "division",
]


def is_nav_word(c: Column) -> Column:
    """DQ-01."""
    return F.lower(F.trim(c)).isin(NAV_WORDS)


def is_numeric_name(c: Column) -> Column:
    """DQ-02: blank, or digits, ``/``, ``-``, ``.`` and white space only."""
    return F.trim(c).rlike(r"^[0-9/\-.\s]*$")


def name_problem(c: Column) -> Column:
    """DQ-03: the first reason why a cell is no person's name, or null. A null cell is too short."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    words = F.split(t, r"(?U)\s+")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z ]", ""), " +", " "))
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    return (
        F.when(F.length(t) < 4, "too_short").when(F.length(t) > 50, "too_long").when((F.size(words) < 2) | (F.size(words) > 4), "wrong_token_count")
        .when(~t.rlike(r"^\p{Lu}"), "first_char_not_upper").when(t == F.upper(t), "all_caps")
        .when(F.exists(words, lambda w: ~w.rlike(r"^\p{L}")), "not_alpha_start").when(t.rlike(r"\d"), "contains_digit")
        .when(plain.isin(BLOCKED_PHRASES), "in_blocklist").when(F.exists(bare, lambda w: w.isin(BLOCKED_WORDS)), "token_in_blocklist")
    )


def fragment_kind(c: Column, gazetteer: dict[str, list[str]] | None = None) -> Column:
    """DQ-05: the category of a text of page furniture, any case, or null."""
    table = [(text.strip().lower(), kind) for kind, texts in reversed((gazetteer or UI_FRAGMENTS).items()) for text in texts]
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in dict(table).items() for x in pair)), F.lower(F.trim(c)))


def flagged(df: DataFrame, column: str, key: str, group: list[str], test: Column, kind: str) -> DataFrame:
    """DQ-01, DQ-02, DQ-04: one flag for each group with its names (one for each casing) and counts."""
    return grouped_casefold(df.where(test), group, column, key).withColumn("flag_type", F.lit(kind))


def problem_counts(df: DataFrame, column: str) -> DataFrame:
    """DQ-06."""
    return df.groupBy(name_problem(F.col(column)).alias("reason")).agg(F.count("*").alias("n"))


def purge(df: DataFrame, condition: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """DQ-07: kept and removed rows; more than ``most`` removals raise ValueError."""
    doomed = df.where(F.coalesce(condition, F.lit(False)))
    if doomed.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows would go")
    return df.where(~F.coalesce(condition, F.lit(False))), doomed

"""Scans (S-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """S-01."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def after_key(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """S-02: one page of a keyset scan. A whole scan needs no pages: it is read in partitions."""
    return df.where(F.col(key) > last).orderBy(key).limit(size)


def recent(df: DataFrame, time: str, as_of: str, days: int, full_scan: bool = False) -> DataFrame:
    """S-03."""
    return df if full_scan else df.where(F.col(time) >= F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))


def csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S-05: all columns as strings by name, missing values empty."""
    df = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))


def seed_leagues(spark: SparkSession, path: str, states: DataFrame) -> DataFrame:
    """S-04: public leagues with a URL, each ``(url, name)`` once, with the state of their association."""
    rows = csv_strings(spark, path, ["name", "url", "association", "has_public_clubs"])
    rows = rows.where((F.col("has_public_clubs") == "True") & (F.col("url") != "")).dropDuplicates(["url", "name"])
    return rows.join(states.select("association", "state"), "association", "left")


def csv_folder(spark: SparkSession, path: str, columns: list[str], required: str) -> DataFrame:
    """S-06: all CSV files of a folder; rows with an empty ``required`` column are skipped."""
    return csv_strings(spark, path, columns).where(F.trim(required) != "")


def csv_kind(header: list[str], kinds: dict[str, set[str]]) -> str | None:
    """S-07: the first kind whose columns are all in the header."""
    have = {h.strip().lower() for h in header}
    return next((kind for kind, need in kinds.items() if need <= have), None)


def csv_kind_of(header: Column, kinds: dict[str, set[str]]) -> Column:
    """S-07 of an array of header cells, as ``csv_kind``."""
    have = F.transform(header, lambda h: F.lower(F.trim(h)))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, need in kinds.items():
        out = out.when(F.size(F.array_except(F.lit(sorted(need)), have)) == 0, kind)
    return out


def checkpoint_sites(spark: SparkSession, path: str) -> DataFrame:
    """S-08: ``key, website, status`` of a JSON checkpoint ``{"processed": {key: {...}}}``."""
    schema = T.StructType([T.StructField("processed", T.MapType(T.StringType(), T.StructType([T.StructField("status", T.StringType()), T.StructField("website", T.StringType())])))])
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("processed").alias("key", "v")).select("key", "v.website", "v.status")


def run_log_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("client_run_id string, seq long, scraper_key string, started_at timestamp_ntz, completed_at timestamp_ntz, status string, records_created long, error_message string").json(path)


def consolidate_runs(events: DataFrame) -> DataFrame:
    """S-09, ST-08: one row for each run: the last value that is not null, the first start."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return events.groupBy("client_run_id").agg(last("scraper_key"), F.min("started_at").alias("started_at"), *(last(c) for c in ("completed_at", "status", "records_created", "error_message")))


def feed_entries(df: DataFrame, xml: str) -> DataFrame:
    """S-13: entries of an Atom feed: ``video_id, title, published``."""
    entries = F.regexp_extract_all(xml, F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))
    part = lambda tag: F.nullif(F.regexp_extract("_e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), F.lit(""))
    return df.withColumn("_e", F.explode(entries)).select(*df.columns, part("yt:videoId").alias("video_id"), part("title").alias("title"), F.try_to_timestamp(part("published")).alias("published"))


def placemarks(df: DataFrame, kml: str) -> DataFrame:
    """S-14: names of a map's placemarks."""
    names = F.regexp_extract_all(kml, F.lit(r"(?s)<Placemark[^>]*>.*?<name>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</name>"), F.lit(1))
    return df.withColumn("name", F.explode(names))


def replay(pages: DataFrame, url: str, rules: list[tuple[str, str]]) -> DataFrame:
    """S-17: pages of a run for each parser that takes their URL."""
    from ..functions.classify import first_match

    return pages.groupBy(first_match(F.col(url), rules, "unmatched").alias("parser")).agg(F.count("*").alias("n"))


def freshness_column(df: DataFrame, candidates: list[str]) -> str | None:
    """S-18: the first candidate that the frame has."""
    return next((c for c in candidates if c in df.columns), None)


def literal_rows(spark: SparkSession, values: list, name: str) -> DataFrame:
    """S-19."""
    return spark.range(1).select(F.explode(F.array(*(F.lit(v) for v in values))).alias(name))


def archive_key(html: Column, at: Column) -> Column:
    """W-24: path of a page in the content-addressed archive."""
    return F.concat_ws("/", F.date_format(at, "yyyy/MM/dd"), F.concat(F.sha2(html, 256), F.lit(".html.gz")))

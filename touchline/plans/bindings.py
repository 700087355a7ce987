"""Domain tables made from the synthetic ones, as frames and as SQL.

The synthetic tables hold no clubs or matches; these views give every operator
an input of the right shape. The SQL twins are common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scans import table

AS_OF = "2024-01-31 00:00:00"


def matches(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (F.col("o_custkey") % 100).alias("home_club_id"),
        F.when(F.col("l_partkey") % 97 != 0, F.col("l_suppkey") % 100).alias("away_club_id"),
        (F.col("l_quantity").cast("long") % 7).alias("home_score"),
        F.when(F.col("l_partkey") % 53 != 0, (F.col("l_linenumber") % 7).cast("long")).alias("away_score"),
        F.year("o_orderdate").cast("string").alias("season"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("league"),
        F.col("l_returnflag").alias("division"), F.col("l_linestatus").alias("age_group"),
        F.when(F.col("o_custkey") % 2 == 0, "M").otherwise("F").alias("gender"),
        F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "P", "postponed").otherwise("scheduled").alias("status"),
        F.col("l_shipdate").alias("match_date"),
    )


MATCHES = """matches AS (
    SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey % 100 AS home_club_id,
           CASE WHEN l_partkey % 97 <> 0 THEN l_suppkey % 100 END AS away_club_id,
           CAST(trunc(l_quantity) AS BIGINT) % 7 AS home_score,
           CASE WHEN l_partkey % 53 <> 0 THEN CAST(l_linenumber AS BIGINT) % 7 END AS away_score,
           CAST(year(o_orderdate) AS VARCHAR) AS season,
           CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS league,
           l_returnflag AS division, l_linestatus AS age_group,
           CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
           CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'P' THEN 'postponed' ELSE 'scheduled' END AS status,
           l_shipdate AS match_date
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def clubs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " FC").when(F.col("p_size") % 3 == 1, " Soccer Club").otherwise("")).alias("name"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("state"),
        F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 5 == 1, "inactive").otherwise("active").alias("status"),
        F.col("p_type").alias("city"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
    )


CLUBS = """clubs AS (
    SELECT p_partkey AS id,
           p_name || CASE p_size % 3 WHEN 0 THEN ' FC' WHEN 1 THEN ' Soccer Club' ELSE '' END AS name,
           CASE WHEN p_size % 7 <> 0 THEN p_brand END AS state,
           CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'inactive' ELSE 'active' END AS status,
           p_type AS city, p_size AS size, p_retailprice AS price
    FROM part)"""


def team_names(spark: SparkSession, d: str) -> DataFrame:
    """Raw team names: a club's name with age, gender and programme words."""
    c = clubs(spark, d)
    tail = F.when(F.col("id") % 6 == 0, " U15 Boys Gold").when(F.col("id") % 6 == 1, " 2011 Girls").when(F.col("id") % 6 == 2, " 64 CA S").when(F.col("id") % 6 == 3, " 16G Pre-ECNL").when(F.col("id") % 6 == 4, " NTX 07 Elite").otherwise(" VA")
    return c.select("id", F.concat("name", tail).alias("raw"), "name", "state")


TEAM_NAMES = CLUBS + """,
team_names AS (
    SELECT id, name || CASE id % 6 WHEN 0 THEN ' U15 Boys Gold' WHEN 1 THEN ' 2011 Girls' WHEN 2 THEN ' 64 CA S'
                       WHEN 3 THEN ' 16G Pre-ECNL' WHEN 4 THEN ' NTX 07 Elite' ELSE ' VA' END AS raw, name, state
    FROM clubs)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Run logs: a key for each user; errors are failures."""
    e = table(spark, d, "events")
    kind = F.when(F.col("user_id") % 4 == 0, "gotsport-rosters:").when(F.col("user_id") % 4 == 1, "gotsport-events:").when(F.col("user_id") % 4 == 2, "youth-coaches:").otherwise("tryouts-x:")
    return e.select(
        F.col("event_id").alias("id"), F.concat(kind, F.col("user_id").cast("string")).alias("scraper_key"), F.col("ts").alias("started_at"),
        F.when(F.col("value") < 30, "failed").when(F.col("value") < 60, "partial").otherwise("ok").alias("status"),
        F.floor("value").cast("long").alias("records_created"), F.concat(F.lit("error "), F.col("event_type")).alias("error_message"),
    )


RUNS = """runs AS (
    SELECT event_id AS id, CASE user_id % 4 WHEN 0 THEN 'gotsport-rosters:' WHEN 1 THEN 'gotsport-events:' WHEN 2 THEN 'youth-coaches:' ELSE 'tryouts-x:' END || CAST(user_id AS VARCHAR) AS scraper_key,
           ts AS started_at, CASE WHEN value < 30 THEN 'failed' WHEN value < 60 THEN 'partial' ELSE 'ok' END AS status,
           CAST(floor(value) AS BIGINT) AS records_created, 'error ' || event_type AS error_message
    FROM events)"""


def affiliations(spark: SparkSession, d: str) -> DataFrame:
    """Customers in leagues (order priorities); every ninth without an id, by name only."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderdate").distinct()
    return o.select(F.col("o_custkey").alias("club_id"), F.when(F.col("o_custkey") % 9 != 0, F.substring("o_orderpriority", 1, 1).cast("int")).alias("league_id"), F.col("o_orderpriority").alias("source_name"), F.col("o_orderdate").alias("seen_at"))


AFFILIATIONS = """affiliations AS (
    SELECT DISTINCT o_custkey AS club_id, CASE WHEN o_custkey % 9 <> 0 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS league_id,
           o_orderpriority AS source_name, o_orderdate AS seen_at FROM orders)"""


def leagues(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority").distinct()
    return o.select(F.substring("o_orderpriority", 1, 1).cast("int").alias("id"), F.col("o_orderpriority").alias("league_name"), (F.substring("o_orderpriority", 1, 1).cast("int") % 3 + 1).alias("tier"))


LEAGUES = """leagues AS (
    SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS id, o_orderpriority AS league_name, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 3 + 1 AS tier FROM orders)"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Roster snapshots: of each customer group and year, orders as players."""
    o = table(spark, d, "orders")
    return o.groupBy((F.col("o_custkey") % 20).alias("club_id"), F.year("o_orderdate").alias("snapshot"), (F.col("o_orderkey") % 37).cast("string").alias("player")).agg(
        F.min("o_orderstatus").alias("jersey"), F.max("o_orderpriority").alias("position")
    ).withColumn("jersey", F.when(F.col("jersey") != "P", F.col("jersey")))


SNAPSHOTS = """snapshots AS (
    SELECT club_id, snapshot, player, CASE WHEN j <> 'P' THEN j END AS jersey, position FROM (
        SELECT o_custkey % 20 AS club_id, CAST(year(o_orderdate) AS INTEGER) AS snapshot, CAST(o_orderkey % 37 AS VARCHAR) AS player,
               min(o_orderstatus) AS j, max(o_orderpriority) AS position FROM orders GROUP BY 1, 2, 3))"""


def link_targets(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Tables with raw team names and club ids that are mostly null: ``id, raw, club_id`` of parts, customers, suppliers and orders.

    Names are a club's, with words swapped, a letter left out, or team words added.
    """
    names = clubs(spark, d).select((F.col("id") % 997).alias("n"), "name").groupBy("n").agg(F.min("name").alias("name"))
    swapped = F.array_join(F.reverse(F.split("name", " ")), " ")
    less = F.regexp_replace("name", "e", "")

    def of(table_name: str, key: str, kinds: list) -> DataFrame:
        t = table(spark, d, table_name).select(F.col(key).alias("id"), (F.col(key) % 997).alias("n")).join(names, "n", "left")
        raw = F.when(F.col("id") % 5 == 4, None)
        for k, kind in enumerate(kinds):
            raw = raw.when(F.col("id") % len(kinds) == k, kind)
        return t.select("id", raw.alias("raw"), F.when(F.col("id") % 11 == 0, F.col("id")).alias("club_id"))

    return {
        "parts": of("part", "p_partkey", [F.concat("name", F.lit(" U15 Boys Gold")), F.concat(less, F.lit(" 2011 Girls"))]),
        "customers": of("customer", "c_custkey", [swapped, F.concat(less, F.lit(" U14")), F.col("name")]),
        "suppliers": of("supplier", "s_suppkey", [F.upper("name"), F.concat(swapped, F.lit(" VA"))]),
        "orders": of("orders", "o_orderkey", [F.concat("name", F.lit(" 07 Elite")), less, F.lit("Lone Wanderers"), F.concat(F.lit("Total "), "name")]),
    }

"""Named queries of streams and of tables that streams and rollups write.

Each runs over micro-batches that Spark deals from a given table, so that its rows are
those of a batch query whatever the cuts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import upsert
from ..operators.lineage import shared_folder
from ..sources import scans
from ..sources.versioned import VersionedTable
from ..streaming import stateful, streams
from . import bindings as b
from .catalog import query

T = scans.table


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _end(df, time: str, **values):
    """One row at the end of time, which closes all that is open; nulls but for ``values``."""
    kinds = {f.name: f.dataType for f in df.schema}
    values = {time: stateful.END} | values
    return df.sparkSession.range(1).select(*(F.lit(values.get(c)).cast(k).alias(c) for c, k in kinds.items()))


def _events(spark, d):
    return T(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_DIFF = f"""WITH {b.SNAPSHOTS}, dates AS (SELECT club_id, snapshot, lag(snapshot) OVER (PARTITION BY club_id ORDER BY snapshot) AS prev FROM (SELECT DISTINCT club_id, snapshot FROM snapshots)),
n AS (SELECT s.*, d.prev FROM snapshots s JOIN dates d USING (club_id, snapshot) WHERE d.prev IS NOT NULL),
o AS (SELECT d.club_id, d.snapshot, s.player, s.jersey, s.position FROM snapshots s JOIN dates d ON s.club_id = d.club_id AND s.snapshot = d.prev),
both_ AS (SELECT coalesce(n.club_id, o.club_id) AS club_id, coalesce(n.snapshot, o.snapshot) AS snapshot, coalesce(n.player, o.player) AS player, n.player IS NULL AS gone, o.player IS NULL AS fresh,
          coalesce(o.jersey, '') AS oj, coalesce(n.jersey, '') AS nj, coalesce(o.position, '') AS op, coalesce(n.position, '') AS np
          FROM n FULL JOIN o ON n.club_id = o.club_id AND n.snapshot = o.snapshot AND n.player = o.player)
SELECT club_id, snapshot, player, 'added' AS diff_type, NULL AS from_value, NULL AS to_value FROM both_ WHERE fresh
UNION ALL SELECT club_id, snapshot, player, 'removed', NULL, NULL FROM both_ WHERE gone
UNION ALL SELECT club_id, snapshot, player, 'jersey_changed', oj, nj FROM both_ WHERE NOT fresh AND NOT gone AND oj <> nj
UNION ALL SELECT club_id, snapshot, player, 'position_changed', op, np FROM both_ WHERE NOT fresh AND NOT gone AND op <> np"""


def _roster_changes(spark, d, cuts: int, stored: int | None = None):
    s = b.snapshots(spark, d).withColumn("at", F.make_timestamp("snapshot", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).drop("snapshot")
    place, initial = _place(spark, "roster-changes"), None
    if stored is not None:  # snapshots up to a year are in the stored table already
        old = s.where(F.year("at") <= stored)
        last = old.groupBy("club_id").agg(F.max("at").alias("at"))
        initial, s = old.join(last, ["club_id", "at"]), s.where(F.year("at") > stored)
    stream = streams.in_cuts(s, f"{place}/in", cuts, end=_end(s, "at"))
    changes = stateful.snapshot_diff_stream(stream, ["club_id"], "at", "player", ["jersey", "position"], "20000 days", initial)
    out = streams.run_available(changes, place, "append", stateful.STORE)
    return out.select("club_id", F.year("at").alias("snapshot"), "player", "diff_type", "from_value", "to_value")


@query(_DIFF)
def roster_change_stream(spark, d):
    """CDC-01 as a stream in two micro-batches."""
    return _roster_changes(spark, d, 2)


@query(f"SELECT * FROM ({_DIFF}) WHERE snapshot > 1996")
def roster_change_stream_resumed(spark, d):
    """CDC-01 as a stream that begins from a stored snapshot (initial state)."""
    return _roster_changes(spark, d, 3, stored=1996)


@query("""WITH r AS (SELECT user_id, value < 30 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT CAST(user_id AS VARCHAR) AS key, coalesce(min(rn) FILTER (WHERE NOT bad), 1 + max(rn)) - 1 AS streak FROM r GROUP BY user_id""")
def streak_stream(spark, d):
    """ST-05: failure streaks from four micro-batches whose rows come in any order."""
    e = _events(spark, d).select("event_id", "ts", "user_id", (F.col("value") < 30).alias("bad"))
    place = _place(spark, "streaks")
    out = streams.run_available(stateful.streak_stream(streams.in_cuts(e, f"{place}/in", 4), "user_id", "ts", "bad", "event_id", "400 days"), place, "update", stateful.STORE, numbered=True)
    return out.groupBy("key").agg(F.max_by("streak", "batch").alias("streak"))


_RUN_SIDES = """s AS (SELECT event_id AS run_id, ts AS started_at FROM events WHERE event_id % 2 = 0),
f AS (SELECT event_id - 1 AS run_id, ts + INTERVAL 1 SECOND * (value * 60) AS finished_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM events WHERE event_id % 2 = 1 AND value > 20)"""


@query(f"""WITH {_RUN_SIDES} SELECT s.run_id, s.started_at, f.finished_at, f.status FROM s LEFT JOIN f ON s.run_id = f.run_id AND f.finished_at >= s.started_at AND f.finished_at <= s.started_at + INTERVAL 2 HOUR""")
def run_outcome_stream(spark, d):
    """ST-08: starts and finishes as two streams; runs without a finish in two hours come out unfinished."""
    e = _events(spark, d)
    starts = e.where("event_id % 2 = 0").select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"))
    took = F.make_dt_interval(secs=(F.col("value") * 60).cast("decimal(18,6)"))
    finishes = e.where("event_id % 2 = 1 AND value > 20").select((F.col("event_id") - 1).alias("run_id"), (F.col("ts") + took).alias("finished_at"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    place = _place(spark, "run-outcomes")
    s = streams.in_cuts(starts, f"{place}/starts", 2, end=_end(starts, "started_at", run_id=-1))
    f = streams.in_cuts(finishes, f"{place}/finishes", 2, end=_end(finishes, "finished_at", run_id=-1))  # a null key would not reach the watermark
    joined = stateful.run_outcomes(s, f, "run_id", "started_at", "finished_at", "2 HOURS", "400 days")
    out = streams.run_available(joined, place, "append").where("run_id >= 0")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "finished_at")})


@query("""WITH p AS (SELECT date_trunc('day', ts) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL),
w AS (SELECT * FROM (VALUES ('24h', 1), ('7d', 7), ('30d', 30), ('90d', 90)) w(width, days)),
e AS (SELECT DISTINCT day + INTERVAL 1 DAY * k AS until FROM p, range(1, 91) r(k))
SELECT width, CAST(until AS TIMESTAMP) AS until, kind, CAST(sum(n) AS BIGINT) AS n FROM w, e JOIN p ON p.day < until AND p.day >= until - INTERVAL 90 DAY WHERE p.day >= until - INTERVAL 1 DAY * days GROUP BY ALL""")
def trailing_window_stream(spark, d):
    """ST-03: counts of the last 24 hours, 7, 30 and 90 days by kind, at each midnight."""
    e = _events(spark, d).select("ts", "event_type")
    place = _place(spark, "trailing")
    out = streams.run_available(stateful.trailing_counts(streams.in_cuts(e, f"{place}/in", 2, end=_end(e, "ts")), "ts", "event_type", "100 days"), place, "append")
    return out.where("kind IS NOT NULL").withColumn("until", F.col("until").cast("timestamp_ntz"))


@query("SELECT o_orderpriority AS league, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, max(o_orderkey) AS last_id FROM orders GROUP BY ALL")
def daily_snapshot_upserts(spark, d):
    """ST-06: one row for each league and day, upserted from five micro-batches into a versioned table; every batch is sent twice."""
    o = T(spark, d, "orders").select(F.col("o_orderpriority").alias("league"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderkey").alias("id"))
    place = _place(spark, "daily-snapshots")
    table = VersionedTable(spark, f"{place}/table")

    def merge(old, batch):
        fresh = batch.groupBy("league", "day").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))
        both = fresh if old is None else old.unionByName(fresh)
        return both.groupBy("league", "day").agg(F.sum("n").alias("n"), F.max("last_id").alias("last_id"))

    apply = table.upsert_batch(merge, "orders")

    def twice(batch, number):
        apply(batch, number)
        apply(batch, number)

    streams.run_batches(streams.in_cuts(o, f"{place}/in", 5), twice, f"{place}/state")
    return table.read()


@query("""SELECT o_orderkey AS platform_id, CAST(o_custkey AS VARCHAR) || '/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || o_orderkey AS natural_key, o_totalprice AS price FROM orders""")
def late_platform_ids(spark, d):
    """ST-02: rows come by natural key first, a third without their platform id, which comes in a later batch and finds its row."""
    o = T(spark, d, "orders")
    key = F.concat(F.col("o_custkey").cast("string"), F.lit("/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/"), F.col("o_orderkey").cast("string"))
    rows = o.select(F.col("o_orderkey").alias("platform_id"), key.alias("natural_key"), F.col("o_totalprice").alias("price"))
    late = F.col("platform_id") % 3 == 0
    first = rows.where(late).select(F.lit(None).cast("long").alias("platform_id"), "natural_key", (F.col("price") - 1).alias("price")).withColumn("turn", F.lit(0))
    sent = first.unionByName(rows.where(~late).withColumn("turn", F.lit(0))).unionByName(rows.where(late).withColumn("turn", F.lit(1)))
    place = _place(spark, "late-ids")
    table = VersionedTable(spark, f"{place}/table")

    def merge(old, batch):
        state = batch.limit(0) if old is None else old
        return upsert.upsert_by_platform_id(state, batch, "platform_id", {"natural_key": ""}).drop("action")

    stream = streams.cut_stream(sent, "turn", [0, 1], f"{place}/in")
    streams.run_batches(stream, table.upsert_batch(merge, "orders"), f"{place}/state")
    return table.read()


@query(f"""WITH {b.MATCHES} SELECT 'old' AS reader, season, count(*) AS n FROM matches WHERE status = 'final' GROUP BY ALL
UNION ALL SELECT 'new', season, count(*) FROM matches GROUP BY ALL""")
def rollup_swapped(spark, d):
    """W-27: a reader that was open before a rollup's replacement ends on the old version, one opened after it reads the new."""
    m = b.matches(spark, d)
    table = VersionedTable(spark, _place(spark, "rollup"))
    by_season = lambda df: df.groupBy("season").agg(F.count("*").alias("n"))
    table.replace(by_season(m.where(F.col("status") == "final")))
    before = table.read()
    table.replace(by_season(m))
    side = lambda df, name: df.select(F.lit(name).alias("reader"), "season", "n")
    return side(before, "old").unionByName(side(table.read(), "new"))

"""Further named queries: lists, details, queues, review steps, KPIs.

Registered with those of ``catalog``; each has its SQL twin where SQL can say it.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify, dates, names
from ..operators import aggregates as agg
from ..operators import filters, joins, quality, upsert, windows
from ..sources import scans
from . import bindings as b
from .catalog import _CELL_SQL, _HALVES, _cells, _halves, query

T = scans.table
DAY = f"TIMESTAMP '{b.AS_OF}'"


# --- events, leagues, rosters ------------------------------------------------------

@query("""SELECT o.o_orderkey, c.c_name, n.n_name, count(*) AS lines, (SELECT count(DISTINCT l_suppkey) FROM lineitem x WHERE x.l_orderkey = o.o_orderkey) AS suppliers
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1995-06-30 00:00:00' GROUP BY 1, 2, 3""")
def event_list(spark, d):
    """Q-12, J-01, J-02, F-07: events of a date range with host, place and team counts."""
    o = filters.where_all(T(spark, d, "orders"), filters.between(F.col("o_orderdate"), "1995-01-01", "1995-06-30"))
    g = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.countDistinct("l_suppkey").alias("suppliers"))
    c, n = T(spark, d, "customer"), T(spark, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey, "left").join(g, o.o_orderkey == g.l_orderkey).select("o_orderkey", "c_name", "n_name", "lines", "suppliers")


@query("""SELECT o_orderkey, coalesce(p, o_orderpriority) AS age FROM (SELECT o.o_orderkey, o.o_orderpriority, CASE WHEN l.l_linenumber % 2 = 0 THEN l.l_returnflag END AS p FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey) WHERE coalesce(p, o_orderpriority) ILIKE '%r%' """)
def event_search_team_age(spark, d):
    """Q-12, F-05: the team's value where it has one, else the event's."""
    o, li = T(spark, d, "orders"), T(spark, d, "lineitem")
    j = o.join(li, o.o_orderkey == li.l_orderkey).withColumn("p", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")))
    return j.where(filters.first_given_like(F.col("p"), F.col("o_orderpriority"), "r")).select("o_orderkey", F.coalesce("p", "o_orderpriority").alias("age"))


@query(f"WITH {b.MATCHES} SELECT m.home_club_id AS club_id, n.n_name AS name, m.season, count(*) AS n FROM matches m LEFT JOIN nation n ON n.n_nationkey = m.home_club_id WHERE m.season IN ('1994', '1996') GROUP BY 1, 2, 3")
def standings_search(spark, d):
    """Q-14, J-02, F-12."""
    m, n = b.matches(spark, d).where(F.col("season").isin("1994", "1996")), T(spark, d, "nation")
    return m.join(n, m.home_club_id == n.n_nationkey, "left").groupBy(F.col("home_club_id").alias("club_id"), F.col("n_name").alias("name"), "season").agg(F.count("*").alias("n"))


@query(f"WITH {b.AFFILIATIONS} SELECT DISTINCT c.c_custkey, c.c_name FROM customer c WHERE c.c_custkey IN (SELECT club_id FROM affiliations WHERE source_name = '2-HIGH')")
def league_clubs(spark, d):
    """Q-16, J-23, A-17: ids of a first step become a semi join."""
    ids = b.affiliations(spark, d).where("source_name = '2-HIGH'").select(F.col("club_id").alias("c_custkey"))
    return T(spark, d, "customer").join(ids, "c_custkey", "left_semi").select("c_custkey", "c_name").distinct()


@query("SELECT s_suppkey, s_name, placed, best FROM (SELECT s_suppkey, s_name, count(*) AS placed, max(l_quantity) AS best FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2) WHERE placed >= 10 ORDER BY placed DESC, s_suppkey LIMIT 20")
def coach_top(spark, d):
    """Q-17, A-09, F-11, O-08."""
    s, li = T(spark, d, "supplier"), T(spark, d, "lineitem")
    g = s.join(li, s.s_suppkey == li.l_suppkey).groupBy("s_suppkey", "s_name").agg(F.count("*").alias("placed"), F.max("l_quantity").alias("best"))
    return filters.where_all(g, filters.at_least(F.col("placed"), 10)).orderBy(F.desc("placed"), F.asc("s_suppkey")).limit(20)


@query("SELECT s.s_suppkey, (SELECT l_orderkey FROM lineitem WHERE l_suppkey = s.s_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC LIMIT 1) AS last_order FROM supplier s")
def lateral_latest(spark, d):
    """J-16: the latest row of each key by one aggregate."""
    last = T(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("m"))
    s = T(spark, d, "supplier")
    return s.join(last, s.s_suppkey == last.l_suppkey, "left").select("s_suppkey", F.col("m.l_orderkey").alias("last_order"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_type ILIKE '%econ%' AND (p_size BETWEEN 10 AND 30) ORDER BY p_size, p_name, p_partkey LIMIT 20")
def college_search(spark, d):
    """Q-18, F-02, O-01, O-06."""
    p = filters.where_all(T(spark, d, "part"), filters.like_any_case(F.col("p_type"), "econ"), F.col("p_size").between(10, 30))
    return filters.page(p.select("p_partkey", "p_name", "p_size"), [F.asc("p_size"), F.asc("p_name"), F.asc("p_partkey")], 1, 20)


@query(f"WITH {b.SNAPSHOTS} SELECT club_id, max(snapshot) AS last, count(*) FILTER (WHERE jersey IS NULL) AS no_jersey, count(DISTINCT player) AS players FROM snapshots GROUP BY 1")
def roster_by_club(spark, d):
    """Q-19, A-01, A-02."""
    return b.snapshots(spark, d).groupBy("club_id").agg(F.max("snapshot").alias("last"), F.count_if(F.col("jersey").isNull()).alias("no_jersey"), F.countDistinct("player").alias("players"))


@query("SELECT status, count(*) AS n, count(DISTINCT c) AS clubs FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'expired' ELSE 'upcoming' END AS status, o_custkey AS c FROM orders) GROUP BY 1")
def tryout_stats(spark, d):
    """Q-41, F-08, W-15."""
    o = T(spark, d, "orders").withColumn("status", F.when(filters.upcoming(F.col("o_orderdate"), "1998-01-01 00:00:00"), "upcoming").otherwise("expired"))
    return o.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("clubs"))


@query("SELECT n_regionkey, string_agg(n_name || '=' || CAST(k AS VARCHAR), ';' ORDER BY n_name) AS by_name FROM (SELECT n_regionkey, n_name, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1")
def counts_as_map(spark, d):
    """CJ-08: counts pivoted to a map, shown as text."""
    n, c = T(spark, d, "nation"), T(spark, d, "customer")
    g = n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy("n_regionkey", "n_name").agg(F.count("c_custkey").alias("k"))
    m = g.groupBy("n_regionkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "k")))).alias("m"))
    return m.select("n_regionkey", F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda x: F.concat(x, F.lit("="), F.col("m")[x].cast("string"))), ";").alias("by_name"))


@query("SELECT o_orderkey, len(list_filter(['1-URGENT', '2-HIGH'], lambda x: x = o_orderpriority)) > 0 AS urgent, CAST(len(list_intersect(string_split(lower(o_orderpriority), '-'), ['high', 'low'])) AS INTEGER) AS shared FROM orders")
def array_tests(spark, d):
    """CJ-01, CJ-04 to CJ-06."""
    words = F.split(F.lower("o_orderpriority"), "-")
    return T(spark, d, "orders").select("o_orderkey", F.array_contains(F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), F.col("o_orderpriority")).alias("urgent"), F.size(F.array_intersect(F.coalesce(words, F.array().cast("array<string>")), F.array(F.lit("high"), F.lit("low")))).alias("shared"))


# --- unions, dedup, sort forms --------------------------------------------------------

@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def union_distinct(spark, d):
    """U-01, U-03, U-04."""
    return T(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(T(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("SELECT k, max_by(src, id) AS src, count(*) AS n FROM (SELECT lower(c_mktsegment) AS k, 'c' AS src, c_custkey AS id FROM customer UNION ALL SELECT lower(event_type), 'e', event_id + 1000000 FROM events) GROUP BY 1")
def concat_dedup(spark, d):
    """U-05, A-25."""
    c = T(spark, d, "customer").select(F.lower("c_mktsegment").alias("k"), F.lit("c").alias("src"), F.col("c_custkey").alias("id"))
    e = T(spark, d, "events").select(F.lower("event_type").alias("k"), F.lit("e").alias("src"), (F.col("event_id") + 1_000_000).alias("id"))
    both = c.unionByName(e, allowMissingColumns=True)
    return both.groupBy("k").agg(F.max_by("src", "id").alias("src"), F.count("*").alias("n"))


@query("SELECT user_id, date_trunc('second', ts) AS at, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY 1, 2")
def dedup_by_second(spark, d):
    """A-27: one row for each natural key with the time cut to seconds."""
    return T(spark, d, "events").groupBy("user_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


@query("SELECT o_orderkey, (ship IS NOT NULL) AS resolved FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS ship FROM orders) ORDER BY (ship IS NOT NULL), ship NULLS FIRST, o_orderkey LIMIT 60")
def queue_order(spark, d):
    """O-02, O-04, O-06: open rows first, nulls first."""
    o = T(spark, d, "orders").withColumn("ship", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return o.orderBy(F.col("ship").isNotNull().asc(), F.asc_nulls_first("ship"), F.asc("o_orderkey")).limit(60).select("o_orderkey", F.col("ship").isNotNull().alias("resolved"))


@query("SELECT p_brand, arg_max(p_name, p_retailprice) AS best, count(*) AS n FROM (SELECT p_brand, p_name, round(p_retailprice * 1000) * 100000 - p_partkey AS p_retailprice FROM part) GROUP BY 1")
def argmax_candidate(spark, d):
    """O-09, J-21: the best row of each key; ties to the first."""
    p = T(spark, d, "part").withColumn("score", F.struct(F.round(F.col("p_retailprice") * 1000).alias("s"), (-F.col("p_partkey")).alias("first")))
    return p.groupBy("p_brand").agg(F.max_by("p_name", "score").alias("best"), F.count("*").alias("n"))


# --- upsert forms, review steps --------------------------------------------------------

@query(f"""WITH {_HALVES} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.segment ELSE n.segment END AS segment,
CASE WHEN o.c_custkey IS NULL THEN 'inserted' WHEN n.c_custkey IS NULL THEN 'kept' WHEN o.segment IS DISTINCT FROM n.segment THEN 'updated' ELSE 'unchanged' END AS action FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def upsert_change_guard(spark, d):
    """W-04, W-11, W-12: a row with nothing new is unchanged."""
    old, new = _halves(spark, d)
    return upsert.upsert(old.select("c_custkey", "segment"), new.select("c_custkey", "segment"), ["c_custkey"])


@query("""WITH p AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_suppkey <> l_partkey),
old AS (SELECT a, b, 'pending' AS decision FROM p WHERE (a + b) % 2 = 0), new AS (SELECT a, b, 'rejected' AS decision FROM p WHERE (a + b) % 3 = 0)
SELECT coalesce(o.a, n.a) AS a, coalesce(o.b, n.b) AS b, coalesce(n.decision, o.decision) AS decision FROM old o FULL JOIN new n ON o.a = n.a AND o.b = n.b""")
def review_decisions(spark, d):
    """Q-02, Q-39, CLS-22: decisions on unordered pairs; a pair with itself is none."""
    li = T(spark, d, "lineitem").where("l_suppkey <> l_partkey")
    a, z = classify.ordered_pair(F.col("l_suppkey"), F.col("l_partkey"))
    p = li.select(a.alias("a"), z.alias("b")).distinct()
    old = p.where("(a + b) % 2 = 0").withColumn("decision", F.lit("pending"))
    new = p.where("(a + b) % 3 = 0").withColumn("decision", F.lit("rejected"))
    return upsert.upsert(old, new, ["a", "b"]).drop("action")


@query("""WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS resolved FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey % 7 = 0)
SELECT r.id, CASE WHEN f.id IS NULL THEN 'not_found' WHEN f.resolved IS NOT NULL THEN 'already_resolved' ELSE 'resolved' END AS outcome FROM r LEFT JOIN f ON f.id = r.id""")
def flag_resolve(spark, d):
    """Q-33, W-10: what asking to resolve each flag comes to."""
    flags = T(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("fid"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("resolved"))
    asked = T(spark, d, "lineitem").where("l_orderkey % 7 = 0").select(F.col("l_orderkey").alias("id")).distinct()
    j = asked.join(flags, asked.id == flags.fid, "left")
    return j.select("id", F.when(F.col("fid").isNull(), "not_found").when(F.col("resolved").isNotNull(), "already_resolved").otherwise("resolved").alias("outcome"))


@query("""WITH a AS (SELECT lower(p_type) AS alias, min(p_partkey) AS club FROM part GROUP BY 1), r AS (SELECT lower(c_mktsegment) AS alias, min(c_custkey) AS club FROM customer GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM r WHERE alias NOT IN (SELECT alias FROM a)""")
def resolve_raw_name(spark, d):
    """Q-31, W-05, W-12: names resolved by hand become aliases."""
    a = T(spark, d, "part").groupBy(F.lower("p_type").alias("alias")).agg(F.min("p_partkey").alias("club"))
    r = T(spark, d, "customer").groupBy(F.lower("c_mktsegment").alias("alias")).agg(F.min("c_custkey").alias("club"))
    return upsert.insert_ignore(a, r, ["alias"])


@query("""WITH s AS (SELECT c_custkey AS id, lower(c_name) AS name, c_nationkey AS state FROM customer WHERE c_custkey % 2 = 0), i AS (SELECT c_custkey + 100000 AS code, c_name AS name, c_nationkey AS state FROM customer WHERE c_custkey % 3 = 0)
SELECT s.id, s.name, s.state, i.code FROM s LEFT JOIN i ON lower(i.name) = s.name AND i.state = s.state UNION ALL SELECT NULL, lower(i.name), i.state, i.code FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.name = lower(i.name) AND s.state = i.state)""")
def school_upsert(spark, d):
    """ER-24, J-20: schools get their code by name and state; the others are added by code."""
    c = T(spark, d, "customer")
    s = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("name"), F.col("c_nationkey").alias("state"))
    i = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 100000).alias("code"), F.lower("c_name").alias("name"), F.col("c_nationkey").alias("state"))
    known = s.join(i, ["name", "state"], "left").select("id", "name", "state", "code")
    return known.unionByName(i.join(s, ["name", "state"], "left_anti").select(F.lit(None).cast("long").alias("id"), "name", "state", "code"))


@query("SELECT l_suppkey AS id, l_orderkey FROM (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00') WHERE rn <= 3")
def retention_prune(spark, d):
    """Q-43, W-16, W-17: by age, then the last ones of each key."""
    li = windows.prune_older(T(spark, d, "lineitem"), "l_shipdate", "1995-01-01 00:00:00", 0)
    return windows.top_n(li, ["l_suppkey"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")], 3).select(F.col("l_suppkey").alias("id"), "l_orderkey")


# --- health, coverage, academies ----------------------------------------------------------

@query(f"""WITH s AS (SELECT user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'club' ELSE 'match' END AS entity_type, max(ts) AS fresh FROM events GROUP BY 1, 2)
SELECT id, entity_type, CASE WHEN fresh >= {DAY} - INTERVAL 168 HOUR THEN CASE WHEN fresh < {DAY} - (CASE entity_type WHEN 'club' THEN INTERVAL 168 HOUR ELSE INTERVAL 24 HOUR END) THEN 'stale' ELSE 'ok' END ELSE 'unknown' END AS status FROM s""")
def health_reconcile(spark, d):
    """Q-25, S-18, CLS-11: fresh rows are ok, and stale beyond their type's hours."""
    s = T(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("fresh")).withColumn("entity_type", F.when(F.col("id") % 2 == 0, "club").otherwise("match"))
    ok = F.when(F.col("fresh") >= F.lit(b.AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 168 HOURS"), "ok").otherwise("unknown")
    return s.select("id", "entity_type", classify.sla_status(ok, F.col("fresh"), F.col("entity_type"), b.AS_OF).alias("status"))


@query(f"""WITH {b.AFFILIATIONS}, {b.LEAGUES}, j AS (SELECT a.club_id, l.league_name, l.tier FROM affiliations a JOIN leagues l ON a.league_id = l.id OR (a.league_id IS NULL AND a.source_name = l.league_name)),
t AS (SELECT min(tier) AS top FROM j), p AS (SELECT club_id, string_agg(DISTINCT league_name, '|' ORDER BY league_name) AS leagues, min(tier) AS best FROM j GROUP BY 1)
SELECT p.club_id, c.c_name AS name, p.leagues, p.best = t.top AS is_top, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.club_id AND o.o_orderstatus = 'P') AS has_pending FROM p, t, customer c WHERE c.c_custkey = p.club_id AND p.best <= 2""")
def pro_academies(spark, d):
    """Q-27, J-05, J-09, J-14."""
    j = joins.either_key(b.affiliations(spark, d), b.leagues(spark, d), ("league_id", "id"), ("source_name", "league_name"))
    top = j.agg(F.min("tier").alias("top"))
    p = j.groupBy("club_id").agg(agg.joined_list("league_name", "|").alias("leagues"), F.min("tier").alias("best")).where("best <= 2")
    c = T(spark, d, "customer")
    out = p.join(c, p.club_id == c.c_custkey).crossJoin(F.broadcast(top))  # one row
    out = joins.with_flags(out, {"has_pending": (T(spark, d, "orders").where("o_orderstatus = 'P'"), "club_id", "o_custkey")})
    return out.select("club_id", F.col("c_name").alias("name"), "leagues", (F.col("best") == F.col("top")).alias("is_top"), "has_pending")


@query("SELECT r.event_id, r.user_id, n.n_name AS name, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events r LEFT JOIN nation n ON n.n_nationkey = r.user_id WHERE r.event_type = 'error' ORDER BY r.event_id DESC LIMIT 30")
def flag_queue(spark, d):
    """Q-32, Q-34, Q-38, CJ-07: a page of flags with names."""
    e, n = T(spark, d, "events").where("event_type = 'error'"), T(spark, d, "nation")
    j = e.join(n, e.user_id == n.n_nationkey, "left").select("event_id", "user_id", F.col("n_name").alias("name"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"))
    return filters.page(j, [F.desc("event_id")], 1, 30)


@query(f"WITH {_CELL_SQL}, hit AS (SELECT id FROM cells WHERE regexp_matches(lower(trim(name)), '^(home|menu|login)$') ORDER BY id LIMIT 200) SELECT id, name FROM cells WHERE id NOT IN (SELECT id FROM hit) AND regexp_matches(lower(trim(name)), '^(home|menu|login)$')")
def orphan_scan(spark, d):
    """Q-35, F-15, W-18: nav words left after a limited deletion."""
    hit = F.lower(F.trim("name")).rlike("^(home|menu|login)$")
    return windows.delete_limited(_cells(spark, d).select("id", "name"), hit, "id", 200).where(hit)


@query(f"SELECT c.c_custkey AS club_id, count(DISTINCT o.o_orderpriority) AS coaches FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderdate > TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1 HAVING count(DISTINCT o.o_orderpriority) = 0")
def empty_staff_pages(spark, d):
    """Q-36, J-12: the range predicate filters the right side before the left join."""
    c, o = T(spark, d, "customer"), T(spark, d, "orders").where(F.col("o_orderdate") > F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy(F.col("c_custkey").alias("club_id")).agg(F.countDistinct("o_orderpriority").alias("coaches")).where("coaches = 0")


@query(f"WITH {b.RUNS} SELECT id, scraper_key, started_at, status FROM runs WHERE status IN ('ok', 'partial') ORDER BY started_at DESC, id DESC LIMIT 100")
def scrape_runs(spark, d):
    """Q-40, F-17: the alias ``success``."""
    r = filters.where_all(b.runs(spark, d), filters.status_is(F.col("status"), "success", ["ok", "partial", "failed", "running"]))
    return r.orderBy(F.desc("started_at"), F.desc("id")).limit(100).select("id", "scraper_key", "started_at", "status")


@query("SELECT o_orderkey, regexp_replace((1 + o_orderkey % 12) || ':30 PM' || CASE o_orderkey % 3 WHEN 0 THEN ' EST' WHEN 1 THEN '  PDT' ELSE '' END, '\\s+[A-Z]{3,4}$', '') AS clock, strftime(o_orderdate, '%Y-%m-%d') AS utc_day, year(o_orderdate) AS y FROM orders".replace("\\\\", "\\"))
def day_stamps(spark, d):
    """DT-09, DT-11, DT-15, DT-16."""
    key = F.col("o_orderkey")
    clock = F.concat((key % 12 + 1).cast("string"), F.lit(":30 PM"), F.when(key % 3 == 0, " EST").when(key % 3 == 1, "  PDT").otherwise(""))
    return T(spark, d, "orders").select("o_orderkey", F.regexp_replace(clock, r"\s+[A-Z]{3,4}$", "").alias("clock"), dates.day(F.col("o_orderdate")).alias("utc_day"), F.year("o_orderdate").cast("long").alias("y"))


@query(f"""WITH {b.TEAM_NAMES} SELECT id, nullif(upper(regexp_extract(raw, '(?i)\\bU-?([0-9]{{1,2}})\\b', 1)), '') AS age, CASE WHEN regexp_matches(raw, '(?i)\\bboys?\\b') THEN 'M' WHEN regexp_matches(raw, '(?i)\\bgirls?\\b') THEN 'F' END AS gender,
trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM team_names""")
def team_tokens(spark, d):
    """STR-21: plain name, age and gender tokens of a team name."""
    raw = F.col("raw")
    gender = F.when(raw.rlike(r"(?i)\bboys?\b"), "M").when(raw.rlike(r"(?i)\bgirls?\b"), "F")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9 ]", " "), r"\s+", " "))
    return b.team_names(spark, d).select("id", F.nullif(F.regexp_extract(raw, r"(?i)\bU-?([0-9]{1,2})\b", 1), F.lit("")).alias("age"), gender.alias("gender"), plain.alias("plain"))


# --- KPIs ---------------------------------------------------------------------------------

@query(f"""WITH {b.RUNS}, k AS (SELECT scraper_key, max(started_at) FILTER (WHERE status = 'ok') AS last_ok, count(*) FILTER (WHERE records_created = 0 AND started_at >= {DAY} - INTERVAL 7 DAY) AS zero, count(*) FILTER (WHERE started_at >= {DAY} - INTERVAL 7 DAY) AS recent FROM runs GROUP BY 1)
SELECT count(*) AS keys, round(100.0 * count(*) FILTER (WHERE last_ok >= {DAY} - INTERVAL 1 DAY) / count(*), 2) AS fresh_pct, round(100.0 * sum(zero) / sum(recent), 2) AS zero_pct FROM k""")
def kpi_freshness(spark, d):
    """K-01, K-02."""
    r = b.runs(spark, d)
    week = dates.within_days(F.col("started_at"), b.AS_OF, 7)
    k = r.groupBy("scraper_key").agg(F.max(F.when(F.col("status") == "ok", F.col("started_at"))).alias("last_ok"), F.count_if((F.col("records_created") == 0) & week).alias("zero"), F.count_if(week).alias("recent"))
    return k.agg(F.count("*").alias("keys"), F.round(F.count_if(dates.within_days(F.col("last_ok"), b.AS_OF, 1)) * 100.0 / F.count("*"), 2).alias("fresh_pct"), F.round(F.sum("zero") * 100.0 / F.sum("recent"), 2).alias("zero_pct"))


@query(f"""WITH {b.MATCHES} SELECT count(*) FILTER (WHERE away_club_id IS NULL) AS backlog, count(*) AS n, CASE WHEN count(*) FILTER (WHERE away_club_id IS NULL) > 1000 THEN 'red' WHEN count(*) FILTER (WHERE away_club_id IS NULL) > 100 THEN 'yellow' ELSE 'green' END AS light FROM matches""")
def kpi_backlog(spark, d):
    """K-05: rows without a link, with a light."""
    g = b.matches(spark, d).agg(F.count_if(F.col("away_club_id").isNull()).alias("backlog"), F.count("*").alias("n"))
    return g.withColumn("light", F.when(F.col("backlog") > 1000, "red").when(F.col("backlog") > 100, "yellow").otherwise("green"))


@query("""WITH p AS (SELECT DISTINCT doc_id AS id FROM labels), s AS (SELECT doc_id FROM documents) SELECT round(100.0 * (SELECT count(*) FROM s WHERE doc_id IN (SELECT id FROM p)) / (SELECT count(*) FROM s), 2) AS pct_archived""")
def kpi_archive_gap(spark, d):
    """K-04: share of rows that have an archived one."""
    flagged = joins.with_flags(T(spark, d, "documents").select("doc_id"), {"archived": (T(spark, d, "labels"), "doc_id", "doc_id")})
    return flagged.agg(F.round(F.count_if("archived") * 100.0 / F.count("*"), 2).alias("pct_archived"))


@query("""WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n, (SELECT median(x.n) FROM e x WHERE x.event_type = e.event_type AND x.day < e.day AND x.day >= e.day - INTERVAL 7 DAY) AS median FROM e""")
def kpi_volume_drift(spark, d):
    """K-06: daily volume against the median of the seven days before."""
    e = T(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return windows.rolling_median(e, ["event_type"], "day", "n").withColumn("day", dates.day(F.col("day")))


@query(f"WITH {b.RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY scraper_key ORDER BY started_at DESC, id DESC) AS rn FROM runs), s AS (SELECT scraper_key, coalesce(min(rn) FILTER (WHERE status <> 'failed'), 1 + max(rn)) - 1 AS depth FROM r GROUP BY 1) SELECT depth, count(*) AS n FROM s GROUP BY 1")
def kpi_failure_depth(spark, d):
    """K-03."""
    s = windows.failure_streak(b.runs(spark, d), "scraper_key", "started_at", "id", F.col("status") == "failed")
    return s.groupBy(F.col("streak").alias("depth")).agg(F.count("*").alias("n"))


@query(f"WITH {b.RUNS}, last AS (SELECT scraper_key, CAST(max(started_at) AS DATE) AS last FROM runs GROUP BY 1) SELECT scraper_key, date_diff('day', last, CAST({DAY} AS DATE)) >= 30 AS due FROM last")
def cadence_due(spark, d):
    """ST-07, DT-12: in January a key is due after 30 days."""
    last = b.runs(spark, d).groupBy("scraper_key").agg(F.max("started_at").cast("date").alias("last"))
    return last.select("scraper_key", dates.is_due(F.col("last"), b.AS_OF).alias("due"))


@query(f"WITH {_CELL_SQL} SELECT CASE WHEN lower(trim(name)) = 'privacy preferences' THEN 'nav_label' END AS kind, count(*) AS n FROM cells GROUP BY 1")
def ui_fragments(spark, d):
    """DQ-05: rows by their category in the gazetteer."""
    return _cells(spark, d).groupBy(quality.fragment_kind(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) OVER (PARTITION BY user_id) AS kinds FROM events GROUP BY 1, 2")
def seen_spans(spark, d):
    """CDC-03, A-18: first and last time, and how many kinds a key has."""
    g = T(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
    return g.withColumn("kinds", F.count("*").over(Window.partitionBy("user_id")))


@query("""WITH p AS (SELECT page_id, url, html, page_id % 6 AS k FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'wordpress' WHEN 1 THEN 'sportsengine' WHEN 2 THEN 'leagueapps' WHEN 3 THEN 'wordpress' WHEN 4 THEN 'sportsengine' ELSE 'unknown' END AS platform, CASE WHEN regexp_matches(url, '/(blog|news)') THEN 'news' ELSE 'page' END AS kind FROM p""")
def page_registry(spark, d):
    """CLS-15, CLS-14: the family of each page's site, after marks of one are put into the page by its id."""
    marks = ['<link href="/a/wp-content/x.css">', '<meta name="Generator" content="SportsEngine 2">', '<script async src="//cdn.leagueapps.com/w.js"></script>', '<meta content="WordPress 6" name="generator">', "", "wp-content leagueapps sportsengine"]
    k = F.col("page_id") % 6
    mark = F.element_at(F.array(*(F.lit(m) for m in marks)), (k + 1).cast("int"))
    url = F.when(k == 4, F.concat(F.lit("https://x.SportsEngine.com/"), "page_id")).otherwise(F.col("url"))
    return T(spark, d, "pages").select("page_id", classify.platform(url, F.concat("html", mark)).alias("platform"), classify.first_match(F.col("url"), [("/(blog|news)", "news")], "page").alias("kind"))


@query("SELECT c_custkey, replace(lower(trim(c_name)), '#', ' ') AS slugged FROM customer")
def name_list(spark, d):
    """STR-08."""
    return T(spark, d, "customer").select("c_custkey", names.person_name(F.col("c_name")).alias("slugged"))

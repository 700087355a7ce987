"""Further named queries: scans, writes, filters, joins and resolution steps over the tables.

Sinks are written to the shared folder that the session names and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import classify
from ..operators import aggregates as agg
from ..operators import entity, filters, joins, quality, upsert
from ..operators.lineage import shared_folder
from ..sources import html, scans, sinks
from ..streaming import streams
from . import bindings as b
from .catalog import query

T = scans.table


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- scans -----------------------------------------------------------------------

@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_scan(spark, d):
    """S-01."""
    return T(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 25")
def keyset_page(spark, d):
    """S-02: the page is the feature."""
    return scans.after_key(T(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 40, 25)


@query("""SELECT DISTINCT n_name AS name, 'https://' || lower(n_name) || '.org' AS url, 'A' || n_regionkey AS association, CASE WHEN n_regionkey <> 3 THEN r_name END AS state
FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 5 <> 0 AND n_nationkey % 4 <> 1""")
def csv_league_seed(spark, d):
    """S-04: nations as leagues, each written twice: public ones with a URL, each once, with their association's state."""
    path, n = _place(spark, "seed"), T(spark, d, "nation")
    rows = n.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".org"))).alias("url"), F.concat(F.lit("A"), "n_regionkey").alias("association"), F.when(F.col("n_nationkey") % 4 == 1, "False").otherwise("True").alias("has_public_clubs"))
    rows.unionByName(rows).write.option("header", True).csv(path)
    states = T(spark, d, "region").where("r_regionkey <> 3").select(F.concat(F.lit("A"), "r_regionkey").alias("association"), F.col("r_name").alias("state"))
    return scans.seed_leagues(spark, path, states).select("name", "url", "association", "state")


@query("""SELECT c_name || ' "b", c' AS name, '' AS city, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE printf('%09d', c_custkey) END AS code FROM customer WHERE c_custkey % 7 <> 0""")
def csv_all_strings(spark, d):
    """S-05, S-06: files of customers with all cells as strings, missing ones and missing columns empty; rows without a key are skipped."""
    path, c = _place(spark, "strings"), T(spark, d, "customer")
    key = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey"))
    rows = c.select(key.alias("key"), F.concat("c_name", F.lit(' "b", c')).alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.format_string("%09d", "c_custkey")).alias("code"))
    rows.repartition(3).write.option("header", True).option("escape", '"').csv(path)
    return scans.csv_folder(spark, path, ["key", "name", "city", "code"], "key").drop("key")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'roster' WHEN 1 THEN 'club' END AS kind FROM customer")
def csv_kinds(spark, d):
    """S-07: the kind of a file by the header that each customer sent."""
    header = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Name, Club ,"), "c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.concat("c_name", F.lit(",CLUB"))).otherwise(F.col("c_mktsegment"))
    return T(spark, d, "customer").select("c_custkey", scans.csv_kind_of(F.split(header, ","), {"roster": {"name", "club"}, "club": {"club"}}).alias("kind"))


@query("SELECT c_name || '|' || c_nationkey AS key, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) || '.org' END AS website, CASE WHEN c_custkey % 2 = 0 THEN 'found' ELSE 'missed' END AS status FROM customer")
def json_checkpoint(spark, d):
    """S-08: customers' checkpoints, a file of several lines for each task."""
    path, c = _place(spark, "checkpoint"), T(spark, d, "customer")
    found = F.col("c_custkey") % 2 == 0
    entry = F.struct(F.when(found, "found").otherwise("missed").alias("status"), F.when(found, F.concat(F.lower("c_name"), F.lit(".org"))).alias("website"))
    rows = c.select((F.floor(F.col("c_custkey") / 500)).alias("file"), F.concat_ws("|", "c_name", F.col("c_nationkey").cast("string")).alias("key"), entry.alias("v"))
    files = rows.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("processed"))
    text = F.concat(F.lit('{\n "processed": '), F.to_json("processed", {"ignoreNullFields": "false"}), F.lit("\n}"))
    files.select(text.alias("value"), "file").write.partitionBy("file").text(path)
    return scans.checkpoint_sites(spark, f"{path}/*")


@query("""SELECT 'r' || event_id AS client_run_id, 'k:' || user_id AS scraper_key, ts AS started_at, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 5 MINUTE END AS completed_at,
    CASE WHEN event_id % 4 = 0 THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value) AS BIGINT) END AS records_created FROM events""")
def run_log_consolidated(spark, d):
    """S-09: start and finish lines of each run as one row, in whatever order they were written; every fourth has no finish."""
    e, path = T(spark, d, "events"), _place(spark, "runs")
    run, none = F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("client_run_id"), lambda t: F.lit(None).cast(t)
    start = e.select(run, F.lit(1).alias("seq"), F.concat(F.lit("k:"), F.col("user_id").cast("string")).alias("scraper_key"), F.col("ts").alias("started_at"), none("timestamp_ntz").alias("completed_at"), F.lit("running").alias("status"), none("long").alias("records_created"))
    done = e.where("event_id % 4 <> 0").select(run, F.lit(2).alias("seq"), none("string").alias("scraper_key"), none("timestamp_ntz").alias("started_at"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("completed_at"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.floor("value").cast("long").alias("records_created"))
    done.unionByName(start).write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return scans.consolidate_runs(scans.run_log_events(spark, path)).drop("error_message")


@query("""SELECT c_custkey AS page_id, CAST(t AS INTEGER) AS table_no, CAST(r AS INTEGER) AS row_no, CASE WHEN t = 1 THEN '{"col0":"' || c_mktsegment || '","col1":"y"}' WHEN r = 0 THEN '{"team":"' || c_name || ' & B","score":"' || c_nationkey || '-1"}' ELSE '{"team":"C","score":"0-0"}' END AS cells
FROM customer, (VALUES (0, 0), (0, 1), (1, 0)) v(t, r) WHERE c_custkey % 2 = 0""")
def html_table_cells(spark, d):
    """S-10, UDF-03: rows of the tables of customers' pages with and without a header; every second page has none."""
    page = F.concat(F.lit("<table><tr><th>Team</th><th>Score</th></tr><tr><td>"), "c_name", F.lit(" &amp; B</td><td>"), F.col("c_nationkey").cast("string"), F.lit("-1</td></tr><tr><td>C</td><td>0-0</td></tr></table><table><tr><td>"), "c_mktsegment", F.lit("</td><td>y</td></tr></table>"))
    pages = T(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.when(F.col("c_custkey") % 2 == 0, page).otherwise("<p>none</p>").alias("html"))
    return html.table_rows(pages, "page_id", "html").select("page_id", "table_no", "row_no", F.to_json("cells").alias("cells"))


@query("SELECT c_custkey AS page_id, kind, CASE n WHEN 0 THEN c_name || ' Cup' WHEN 1 THEN c_mktsegment ELSE 'Final' END AS name FROM customer, (VALUES (0, 'Event'), (1, 'Place'), (2, 'Event')) v(n, kind) WHERE c_custkey % 2 = 0")
def linked_data_objects(spark, d):
    """S-11, CJ-09: objects of customers' pages; lists and ``@graph`` are flattened; a broken block is skipped."""
    block = lambda *c: F.concat(F.lit('<script type="application/ld+json">'), *c, F.lit("</script>"))
    page = F.concat(block(F.lit('{"@graph":[{"@type":"Event","name":"'), "c_name", F.lit(' Cup"},[{"@type":"Place","name":"'), "c_mktsegment", F.lit('"}]]}')), block(F.lit("{broken")), block(F.lit('[{"@type":"Event","name":"Final"}]')))
    pages = T(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.when(F.col("c_custkey") % 2 == 0, page).otherwise("<p></p>").alias("html"))
    return html.linked_data(pages, "page_id", "html").select("page_id", "kind", F.get_json_object("body", "$.name").alias("name"))


@query("""SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 0 THEN '{"a":{"b":"}' || c_name || '"},"c":' || c_nationkey || '}' END AS body, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS c FROM customer""")
def embedded_objects(spark, d):
    """S-12: the balanced object behind a marker of customers' pages."""
    page = F.concat(F.lit('<script>window.data = {"a":{"b":"}'), "c_name", F.lit('"},"c":'), F.col("c_nationkey").cast("string"), F.lit("}; var x = {};</script>"))
    pages = T(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.when(F.col("c_custkey") % 2 == 0, page).otherwise("<script>none</script>").alias("html"))
    return pages.select("page_id", html.embedded_json(F.col("html"), "window.data =").alias("body")).withColumn("c", F.get_json_object("body", "$.c"))


@query("SELECT 'v' || o_orderkey AS video_id, o_orderpriority AS title, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS published FROM orders")
def feed_videos(spark, d):
    """S-13: orders as entries of their customers' feeds; every third has no date."""
    o = T(spark, d, "orders")
    entry = F.concat(F.lit("<entry><yt:videoId>v"), F.col("o_orderkey").cast("string"), F.lit("</yt:videoId><title>"), "o_orderpriority", F.lit("</title>"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("<published>"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("</published>"))).otherwise(""), F.lit("</entry>"))
    feeds = o.select((F.floor(F.col("o_orderkey") / 100)).alias("feed"), entry.alias("e")).groupBy("feed").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list("e"), ""), F.lit("</feed>")).alias("xml"))
    return scans.feed_entries(feeds, "xml").select("video_id", "title", F.col("published").cast("timestamp_ntz").alias("published"))


@query("SELECT s_suppkey // 50 AS map_id, s_name AS name FROM supplier")
def map_placemarks(spark, d):
    """S-14: suppliers as placemarks of maps, every second name as CDATA."""
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("<![CDATA["), "s_name", F.lit("]]>"))).otherwise(F.col("s_name"))
    mark = F.concat(F.lit("<Placemark id='1'><name>"), name, F.lit("</name></Placemark>"))
    maps = T(spark, d, "supplier").select(F.floor(F.col("s_suppkey") / 50).alias("map_id"), mark.alias("m")).groupBy("map_id").agg(F.concat(F.lit("<kml>"), F.array_join(F.collect_list("m"), ""), F.lit("</kml>")).alias("kml"))
    return scans.placemarks(maps, "kml").select("map_id", "name")


# --- writes -------------------------------------------------------------------------

@query("SELECT o.o_orderkey, coalesce(CASE WHEN o.o_custkey % 3 = 0 THEN c.c_name END, c.c_name) AS label FROM (SELECT o_orderkey, o_custkey FROM orders) o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def update_from(spark, d):
    """W-13: a null column is filled from another table."""
    c = T(spark, d, "customer")
    o = T(spark, d, "orders").join(c.select(F.col("c_custkey").alias("k"), "c_name"), F.col("o_custkey") == F.col("k"), "left")
    o = o.select("o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 3 == 0, F.col("c_name")).alias("label"))
    return upsert.fill_from(o, "label", "o_custkey", c, "c_custkey", "c_name").select("o_orderkey", "label")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def mark_missing(spark, d):
    """W-14: a flag falls where no row exists."""
    c = T(spark, d, "customer").select("c_custkey", F.lit(True).alias("has_orders"))
    return upsert.mark_missing(c, ["c_custkey"], T(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "has_orders")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' \"x\", y' AS name, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS city, p_brand FROM part")
def csv_round_trip(spark, d):
    """W-21, W-22: one folder for each brand, quotes doubled, nulls empty; read back as strings."""
    path = _place(spark, "export")
    p = T(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(' "x", y')).alias("name"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("city"), "p_brand")
    sinks.write_csv(p, path, ["id", "name", "city", "p_brand"], ["p_brand"])
    return scans.csv_strings(spark, path, ["id", "name", "city", "p_brand"])


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders WHERE o_orderstatus = 'P'")
def audit_lines(spark, d):
    """W-23, W-26: rows that would change go to JSON lines, nulls kept; the table itself is not touched."""
    path = _place(spark, "audit")
    sinks.write_audit(T(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority")), path)
    return spark.read.schema("o_orderkey long, o_orderstatus string, priority string").json(path)


@query("SELECT sha256(html) AS sha256, '2024/01/31/' || sha256(html) || '.html.gz' AS path FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 10 = 0) GROUP BY html")
def archive_new(spark, d):
    """W-24: contents not archived yet, each once; every tenth page counts as known."""
    p = T(spark, d, "pages").withColumn("at", F.lit(b.AS_OF).cast("timestamp_ntz"))
    known = p.where("page_id % 10 = 0").select(F.sha2("html", 256).alias("sha256"))
    return sinks.archive(p, known, "html", "at").select("sha256", "path")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def rollup_replaced(spark, d):
    """W-27: the rollup's table is written anew, twice, and read."""
    path = _place(spark, "rollup")
    rollup = T(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    sinks.replace_table(rollup.limit(0), path)
    sinks.replace_table(rollup, path)
    return spark.read.parquet(path)


@query("""WITH r AS (SELECT event_id, CASE WHEN value < 30 THEN 'timeout' END AS failure_kind, CAST(floor(value) AS BIGINT) % 3 AS made, user_id % 2 AS failed, event_type <> 'login' AS done FROM events)
SELECT event_id, CASE WHEN NOT done THEN 'running' WHEN failure_kind IS NOT NULL AND made = 0 THEN 'failed' WHEN failure_kind IS NOT NULL OR failed > 0 THEN 'partial' ELSE 'ok' END AS status FROM r""")
def run_outcomes(spark, d):
    """W-28."""
    e = T(spark, d, "events").select("event_id", F.when(F.col("value") < 30, "timeout").alias("failure_kind"), (F.floor("value") % 3).alias("records_created"), F.lit(0).alias("records_updated"), (F.col("user_id") % 2).alias("records_failed"), F.when(F.col("event_type") != "login", F.col("ts")).alias("completed_at"))
    return sinks.run_outcome(e).select("event_id", "status")


# --- filters ---------------------------------------------------------------------------

@query(f"WITH {b.CLUBS} SELECT id, state IS NULL AS no_state FROM clubs WHERE (state IS NULL OR state = '') OR (status IS NOT NULL AND status <> '' AND size >= 10 AND size <= 20)")
def presence_and_range(spark, d):
    """F-10, F-23: one column absent, or another present within a range."""
    size = F.col("size")
    hit = filters.present(F.col("state"), False) | (filters.present(F.col("status"), True) & filters.at_least(size, 10) & (size <= 20))
    return b.clubs(spark, d).where(hit).select("id", F.col("state").isNull().alias("no_state"))


@query("SELECT o_orderkey, 'o_orderstatus' AS \"column\", o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def domain_violations(spark, d):
    """F-13."""
    o = T(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return filters.outside_domain(o, {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}).select("o_orderkey", "column", "value")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE false GROUP BY 1")
def unknown_status(spark, d):
    """F-18: an unknown status matches nothing where the filter is strict."""
    o = T(spark, d, "orders")
    return filters.where_all(o, filters.status_is(F.col("o_orderstatus"), "nonsense", ["F", "O"], strict=True)).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {b.CLUBS} SELECT id, coalesce(state, '?') AS state, coalesce(status, 'unknown') AS status FROM clubs WHERE (status = 'active') IS NOT TRUE ORDER BY id LIMIT 50 OFFSET 50")
def not_active_page(spark, d):
    """F-20, F-21, F-22: the second page of clubs that are not active, with defaults."""
    page, size = filters.clamp_page(2, 50)
    rows = b.clubs(spark, d).where(filters.not_true(F.col("status") == "active"))
    return filters.with_defaults(rows.select("id", "state", "status"), {"state": "?", "status": "unknown"}).orderBy("id").offset((page - 1) * size).limit(size)


@query(f"WITH {b.CLUBS} SELECT CASE WHEN state IS NULL OR trim(state) = '' THEN 'no_state' WHEN size < 5 THEN 'too_small' WHEN coalesce(status = 'inactive', true) THEN 'closed' ELSE 'valid' END AS reason, count(*) AS n FROM clubs GROUP BY 1")
def row_rejects(spark, d):
    """F-24, F-25, W-25: a cascade of checks splits good rows from the rest, with the first reason."""
    rules = [(filters.blank(F.col("state")), "no_state"), (F.col("size") < 5, "too_small"), (F.col("status") == "inactive", "closed")]
    good, bad = filters.split_valid(b.clubs(spark, d), rules)
    return good.withColumn("reason", F.lit("valid")).unionByName(bad).groupBy("reason").agg(F.count("*").alias("n"))


# --- joins and aggregations -------------------------------------------------------------

@query("WITH i AS (SELECT n_name AS k, n_nationkey AS v FROM nation) SELECT c_custkey, coalesce(a.v, x.v) AS nation FROM customer LEFT JOIN i a ON a.k = c_mktsegment LEFT JOIN nation n ON n.n_nationkey = c_nationkey LEFT JOIN i x ON x.k = n.n_name")
def two_key_lookup(spark, d):
    """J-19: by the segment as a name, else by the nation's name."""
    n = T(spark, d, "nation")
    c = T(spark, d, "customer").join(n, F.col("c_nationkey") == n.n_nationkey, "left").select("c_custkey", "c_mktsegment", "n_name")
    return joins.first_of_two_keys(c, ["c_mktsegment", "n_name"], n.select(F.col("n_name").alias("k"), F.col("n_nationkey").alias("v")), "k", "v", "nation").select("c_custkey", "nation")


@query("SELECT lower(p_name) AS name, min(p_partkey) AS id, count(DISTINCT p_partkey) > 1 AS ambiguous FROM part GROUP BY 1")
def name_ids(spark, d):
    """J-24."""
    return joins.name_map(T(spark, d, "part"), F.lower("p_name"), "p_partkey")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) AS n FROM orders GROUP BY 1")
def filtered_counts(spark, d):
    """A-05."""
    return T(spark, d, "orders").groupBy("o_orderpriority").agg(agg.count_where(F.col("o_orderstatus") == "F").alias("finished"), F.count("*").alias("n"))


@query(f"WITH {b.CLUBS} SELECT id, CAST(CASE WHEN trim(name) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(state) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(status) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(city) <> '' THEN 1 ELSE 0 END AS INTEGER) AS filled FROM clubs")
def completeness_scores(spark, d):
    """A-23."""
    return b.clubs(spark, d).select("id", agg.completeness(["name", "state", "status", "city"]).alias("filled"))


@query(f"WITH {b.CLUBS} SELECT name AS key, arg_min(nullif(trim(state), ''), id) FILTER (WHERE trim(state) <> '') AS state, arg_min(nullif(trim(status), ''), id) FILTER (WHERE trim(status) <> '') AS status FROM clubs GROUP BY name")
def first_wins(spark, d):
    """A-26: for each name the first state and status that are given."""
    return agg.merge_first(b.clubs(spark, d), F.col("name"), "id", ["state", "status"])


# --- resolution, quality, streams ---------------------------------------------------------

@query(f"WITH {b.CLUBS} SELECT id FROM clubs WHERE lower(name) NOT IN (SELECT DISTINCT lower(name) FROM clubs WHERE size = 1)")
def ignore_listed(spark, d):
    """ER-06: names on an ignore list, in any case, are left out."""
    c = b.clubs(spark, d)
    return filters.not_listed(c, "name", c.where("size = 1").select(F.upper("name").alias("listed")), "listed", any_case=True).select("id")


@query("""WITH l AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1)
SELECT c_custkey, coalesce(l.n, 0) AS lineitems, coalesce(c.n, 0) AS customers, coalesce(e.n, 0) AS events, coalesce(l.n, 0) + coalesce(c.n, 0) + coalesce(e.n, 0) AS "references", coalesce(l.n, 0) + coalesce(c.n, 0) + coalesce(e.n, 0) = 0 AS deletable
FROM customer LEFT JOIN l ON l.k = c_custkey LEFT JOIN c ON c.k = c_custkey LEFT JOIN e ON e.k = c_custkey WHERE length(c_name) > 17 OR lower(trim(c_name)) IN ('customer#000000003')""")
def junk_names(spark, d):
    """ER-22: junk names with the rows of each table that refer to them, deletable without any."""
    tables = {"lineitems": (T(spark, d, "lineitem"), "l_suppkey"), "customers": (T(spark, d, "customer"), "c_nationkey"), "events": (T(spark, d, "events"), "user_id")}
    found = entity.deletable(T(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "c_name", ["customer#000000003"], tables, longest=17)
    return found.select("c_custkey", *tables, "references", "deletable")


@query("SELECT s_suppkey, CAST(n AS BIGINT) AS \"references\", n = 0 AS deletable FROM (SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n FROM supplier WHERE length(s_name) > 17 OR lower(trim(s_name)) IN ('supplier#000000003'))")
def junk_suppliers(spark, d):
    """ER-22: junk names with the number of rows that refer to them, over the whole table."""
    return entity.deletable(T(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "s_name", ["supplier#000000003"], {"lineitems": (T(spark, d, "lineitem"), "l_suppkey")}, longest=17).select("s_suppkey", "references", "deletable")


@query(f"WITH {b.CLUBS} SELECT regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, arg_min(city, id) AS city, string_agg(DISTINCT name, '|' ORDER BY name) AS aliases FROM clubs GROUP BY 1")
def seed_slugs(spark, d):
    """ER-23: one club for each slug; the first city wins; all spellings are aliases."""
    return entity.seed_clubs(b.clubs(spark, d), "name", "id", ["city"]).select("slug", "city", F.array_join("aliases", "|").alias("aliases"))


@query(f"WITH {b.CLUBS}, s AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'own' END AS w, CASE WHEN id % 3 = 0 THEN 'db' END AS w1, CASE WHEN id % 2 = 0 THEN 'dir' END AS w2 FROM clubs) SELECT id, coalesce(w, w1, w2) AS website, CASE WHEN w IS NOT NULL THEN 'stored' WHEN w1 IS NOT NULL THEN 'database' WHEN w2 IS NOT NULL THEN 'directory' END AS website_source FROM s")
def website_priority(spark, d):
    """ER-18."""
    c = b.clubs(spark, d).select("id", F.when(F.col("id") % 4 == 0, "own").alias("website"))
    one = lambda n, v: c.where(F.col("id") % n == 0).select("id", F.lit(v).alias("website"))
    return entity.merge_websites(c, "id", [("database", one(3, "db")), ("directory", one(2, "dir"))]).select("id", "website", "website_source")


@query("WITH p AS (SELECT c_custkey, c_nationkey, 'no-email' AS tail FROM customer) SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey) AS winner_id, count(*) OVER (PARTITION BY c_nationkey) AS group_size FROM p WHERE c_custkey % 5 <> 0")
def rehash_cutover(spark, d):
    """ER-20: people whose last seen name is their nation's; every fifth is manually merged."""
    c, n = T(spark, d, "customer"), T(spark, d, "nation")
    people = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.lit(None).cast("string").alias("primary_email"), (F.col("c_custkey") % 5 == 0).alias("manually_merged"))
    seen = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("person_id"), F.concat(F.lit("nation "), F.col("n_name")).alias("name"), F.lit(2).alias("last_seen_at"))
    stale = seen.withColumn("name", F.concat("name", F.lit(" old"))).withColumn("last_seen_at", F.lit(1))
    return entity.rehash(people, seen.unionByName(stale)).select("id", "winner_id", "group_size")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN o_custkey WHEN c_custkey % 5 <> 0 THEN c_custkey END AS person_id, coalesce(o_custkey % 3 <> 0 AND c_custkey % 5 <> 0, false) AS relinked FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def relink_orphans(spark, d):
    """ER-21: orders without a person find the customer by the hash of the name."""
    c = T(spark, d, "customer")
    people = c.select(F.col("c_custkey").alias("id"), classify.person_hash(F.concat(F.lit("n"), F.col("c_custkey")), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("person_hash"), (F.col("c_custkey") % 5 == 0).alias("manually_merged"))
    orphans = T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("person_id"), F.concat(F.lit("N"), F.col("o_custkey")).alias("name"), F.lit(None).cast("string").alias("email"))
    return entity.relink(orphans, people)


@query("SELECT s_nationkey, count(*) AS n, max(s_suppkey) AS max_id, string_agg('Ann Lee' || s_suppkey, '|' ORDER BY 'Ann Lee' || s_suppkey) AS names, 'polluted' AS flag_type FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1")
def polluted_names(spark, d):
    """DQ-04: names that the guard rejects (every second one carries a digit here), flagged by group."""
    s = T(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Ann Lee"), F.col("s_suppkey"))).otherwise("Ann Lee").alias("name"))
    out = quality.flagged(s, "name", "s_suppkey", ["s_nationkey"], quality.name_problem(F.col("name")).isNotNull(), "polluted")
    return out.withColumn("names", F.array_join("names", "|"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT (o_orderkey % 50 = 7) GROUP BY 1")
def purge_checked(spark, d):
    """DQ-07: rows go only if no more than expected would."""
    o = T(spark, d, "orders")
    kept, _ = quality.purge(o, F.col("o_orderkey") % 50 == 7, most=o.count())
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n FROM events GROUP BY 1")
def reingested(spark, d):
    """ST-01: every event arrives twice; those of one id count once."""
    path = _place(spark, "twice")
    e = T(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    e.unionByName(e).write.parquet(path)
    out = streams.run_available(streams.once_each(streams.file_stream(spark, path), ["event_id"], "ts", "3650 days"), f"{path}-counted", mode="append")
    return out.groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.count("*").alias("n"))

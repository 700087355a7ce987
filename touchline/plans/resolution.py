"""Named queries of entity resolution: linking of many tables, external diffs, merges and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entity, linking, merging
from ..sources import scans
from . import bindings as b
from .catalog import _TOKENS_SQL as TOKENS_SQL
from .catalog import query

T = scans.table


def _linked(spark, d):
    clubs = b.clubs(spark, d).groupBy("name").agg(F.min("id").alias("id"))
    aliases = clubs.where("id % 10 = 0").select(F.col("id").alias("club_id"), F.concat("name", F.lit(" Select")).alias("alias"), F.lit("manual").alias("source"))
    ignored = clubs.where("id % 13 = 0").select(F.concat("name", F.lit(" U15 Boys Gold")).alias("raw_team_name"))
    targets = [linking.Target(name, frame, "id", "raw", "club_id") for name, frame in b.link_targets(spark, d).items()]
    return linking.link_all(targets, clubs, aliases, ignored)


@query()
def linked_targets(spark, d):
    """ER-08, ER-04, ER-05, ER-06: every row with a null club of four tables, with the club and the pass that found it."""
    return _linked(spark, d)[1]


@query()
def linker_counts(spark, d):
    """ER-08: results by table."""
    return linking.linker_stats(_linked(spark, d)[1])


@query()
def linker_aliases(spark, d):
    """W-12: aliases after a linker run, each with its source and what became of it."""
    return _linked(spark, d)[2]


@query()
def external_diff(spark, d):
    """ER-17: customers' team names against the clubs of their state."""
    c = b.clubs(spark, d).select("id", "state", "name")
    states = c.select((F.col("id") % 997).alias("n"), "state").groupBy("n").agg(F.min("state").alias("state"))
    e = b.link_targets(spark, d)["customers"].select("raw", (F.col("id") % 997).alias("n")).join(states, "n", "left")
    return entity.diff_with_master(e.select("state", F.col("raw").alias("name")), c)


# --- merges and splits ---------------------------------------------------------------

def _merged(spark, d):
    c = b.clubs(spark, d).select("id", "name", "state", (F.col("id") % 7 == 0).alias("manually_merged"))
    losers = c.where("id % 10 BETWEEN 1 AND 3").select(F.col("id").alias("loser"), (F.col("id") - F.col("id") % 10).alias("winner"))
    aliases = c.where("id % 10 = 2").select(F.col("id").alias("club_id"), F.concat("name", F.lit(" Select")).alias("alias"), F.lit("manual").alias("source"), F.lit(None).cast("long").alias("merged_from"))
    lines = T(spark, d, "lineitem").select("l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("lines"))
    orders = T(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("entity_id"), F.when(F.col("o_orderkey") % 2 == 0, "club").otherwise("college").alias("entity_type"))
    references = [merging.Reference("lines", "l_partkey", ["l_orderkey"]), merging.Reference("career", "entity_id", None, F.col("entity_type") == "club")]
    return merging.merge_clubs(c, aliases, {"lines": lines, "career": orders}, references, losers)


_LOSERS = f"""{b.CLUBS}, asked AS (SELECT id AS loser, id - id % 10 AS winner FROM clubs WHERE id % 10 BETWEEN 1 AND 3),
judged AS (SELECT a.*, CASE WHEN w.id IS NULL THEN 'winner not found' WHEN a.loser % 7 = 0 OR a.winner % 7 = 0 THEN 'manually merged' END AS reason FROM asked a LEFT JOIN clubs w ON w.id = a.winner),
m AS (SELECT loser, winner FROM judged WHERE reason IS NULL)"""


@query(f"WITH {_LOSERS} SELECT * FROM judged")
def merge_outcomes(spark, d):
    """ER-13: every merge asked for, with the reason why it was skipped."""
    return _merged(spark, d)[1]


@query(f"""WITH {_LOSERS}, li AS (SELECT l_orderkey, l_partkey, count(*) AS lines FROM lineitem GROUP BY ALL),
r AS (SELECT l_orderkey, coalesce(winner, l_partkey) AS l_partkey, lines, loser, row_number() OVER (PARTITION BY coalesce(winner, l_partkey), l_orderkey ORDER BY loser NULLS FIRST) AS rn FROM li LEFT JOIN m ON l_partkey = loser)
SELECT l_orderkey, l_partkey, lines FROM r WHERE loser IS NULL OR rn = 1""")
def merged_lines(spark, d):
    """ER-13: a table after the merges; of rows with the same unique key the winner's stays, else the least loser's."""
    return _merged(spark, d)[0]["lines"]


@query(f"WITH {_LOSERS} SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(winner, o_custkey % 50) ELSE o_custkey % 50 END AS entity_id, CASE WHEN o_orderkey % 2 = 0 THEN 'club' ELSE 'college' END AS entity_type FROM orders LEFT JOIN m ON loser = o_custkey % 50")
def merged_careers(spark, d):
    """ER-13: careers point to entities of several types; only those of clubs move."""
    return _merged(spark, d)[0]["career"]


@query(f"""WITH {_LOSERS}, a AS (SELECT coalesce(m.winner, c.id) AS club_id, c.name || ' Select' AS alias, 'manual' AS source, CAST(NULL AS BIGINT) AS merged_from, m.loser FROM clubs c LEFT JOIN m ON m.loser = c.id WHERE c.id % 10 = 2),
n AS (SELECT m.winner AS club_id, c.name AS alias, 'merger-auto' AS source, min(m.loser) AS merged_from FROM m JOIN clubs c ON c.id = m.loser GROUP BY ALL)
SELECT club_id, alias, source, merged_from FROM a UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.club_id = n.club_id AND a.alias = n.alias)""")
def merged_aliases(spark, d):
    """ER-13, W-05: the losers' names as aliases of their winners."""
    return _merged(spark, d)[0]["aliases"]


@query(f"""WITH {b.CLUBS}, p AS (SELECT id AS a, id + 1 AS b, CASE WHEN id % 4 = 0 THEN 'pending' ELSE 'rejected' END AS status, CASE WHEN id % 8 = 0 THEN id ELSE id + 1 END AS winner FROM clubs WHERE id % 2 = 0 AND id + 1 IN (SELECT id FROM clubs))
SELECT c.id, c.name, c.id IN (SELECT winner FROM p WHERE status = 'pending') AS manually_merged FROM clubs c WHERE c.id NOT IN (SELECT CASE WHEN winner = a THEN b ELSE a END FROM p WHERE status = 'pending')""")
def reviewed_clubs(spark, d):
    """ER-14, Q-39: clubs after the merges that reviewers decided."""
    c = b.clubs(spark, d).select("id", "name", F.lit(False).alias("manually_merged"))
    pairs = c.where("id % 2 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.when(F.col("id") % 4 == 0, "pending").otherwise("rejected").alias("status"), F.when(F.col("id") % 8 == 0, F.col("id")).otherwise(F.col("id") + 1).alias("winner"))
    pairs = pairs.join(c.select(F.col("id").alias("b")), "b")
    lines = T(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return merging.merge_reviewed(c, {"lines": lines}, [merging.Reference("lines", "l_partkey")], pairs)[0]["clubs"]


def _split(spark, d):
    c = b.clubs(spark, d).select((F.col("id") % 20).alias("id"), "state").groupBy("id").agg(F.min("state").alias("state")).withColumn("name", F.concat(F.lit("Club "), F.col("id").cast("string")))
    raw = b.link_targets(spark, d)
    held = {name: raw[name].select("id", (F.col("id") % 20).alias("club_id"), (F.col("id") % 19).alias("other_id"), "raw") for name in ("customers", "suppliers", "orders")}
    aliases = b.team_names(spark, d).select("id", (F.col("id") % 20).alias("club_id"), F.col("raw").alias("alias"))
    roots = b.clubs(spark, d).where("size % 3 = 2").select(F.lower("name").alias("root")).distinct()
    four = F.explode(F.array(*(F.lit(k).cast("long") for k in (0, 5, 10, 15))))  # the clubs that a reviewer takes apart
    splits = roots.select(four.alias("source_id"), "root", F.concat(F.lit("New "), F.col("root")).alias("new_name"))
    references = [("customers", "club_id", "raw"), ("suppliers", "club_id", "raw"), ("orders", "club_id", "raw"), ("orders", "other_id", "raw")]
    return merging.split_clubs(c, aliases, held, references, splits)


@query()
def split_moves(spark, d):
    """ER-16: rows that moved to the new clubs, by place and root."""
    return _split(spark, d)[2]


@query()
def split_clubs(spark, d):
    """ER-16: the new clubs."""
    return _split(spark, d)[1]


@query("""WITH g AS (SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey) AS winner FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1)
SELECT winner AS winner_id, g.id AS loser_id, coalesce(n.n, 0) AS moved FROM g LEFT JOIN n USING (id) WHERE g.id <> winner""")
def rehash_audit(spark, d):
    """ER-20: the cutover's audit rows: orders of customers of one nation move to the least."""
    c = T(spark, d, "customer")
    people = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("display_name"), F.lit(None).cast("string").alias("primary_email"), (F.col("c_custkey") % 5 == 0).alias("manually_merged"), F.lit("old").alias("person_hash"))
    found = T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person_id"), F.lit(None).cast("string").alias("name"), F.col("o_orderdate").alias("last_seen_at"))
    groups = entity.rehash(people, found.limit(0))
    return merging.apply_rehash(groups, people, found)[2].drop("person_hash")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 <> 0 THEN 'inserted' WHEN c_custkey % 6 = 0 THEN CASE WHEN c_custkey % 12 = 0 THEN 'unchanged' ELSE 'updated' END ELSE 'kept' END END AS action
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def metadata_upsert(spark, d):
    """W-11: JSON objects whose keys come in another order are no change."""
    c = T(spark, d, "customer")
    text = lambda *c: F.concat(*c)
    k = F.col("c_custkey").cast("string")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), text(F.lit('{"a": "'), k, F.lit('", "b": "x"}')).alias("metadata"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 12 == 0, text(F.lit('{"b":"x","a":"'), k, F.lit('"}'))).otherwise(text(F.lit('{"b":"y","a":"'), k, F.lit('"}'))).alias("metadata"))
    return merging.upsert_metadata(old, new, ["id"], "metadata").select("id", "action")


@query("""WITH h AS (SELECT CAST(o_orderdate AS DATE) AS snapshot_date, o_orderpriority AS league, count(DISTINCT o_custkey) AS clubs, count(*) FILTER (WHERE o_orderstatus = 'F') AS scraped FROM orders GROUP BY ALL), t AS (SELECT max(snapshot_date) AS last FROM h)
SELECT strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, league, clubs, CASE WHEN snapshot_date = last THEN scraped + 1 ELSE scraped END AS scraped FROM h, t WHERE snapshot_date >= last - 365""")
def coverage_snapshots(spark, d):
    """Q-28: a year of daily coverage by league after the last day's snapshot was taken again."""
    o = T(spark, d, "orders")
    day = o.groupBy(F.col("o_orderdate").cast("date").alias("snapshot_date"), F.col("o_orderpriority").alias("league")).agg(F.countDistinct("o_custkey").alias("clubs"), F.count_if(F.col("o_orderstatus") == "F").alias("scraped"))
    last = day.agg(F.max("snapshot_date").alias("last"))
    today = day.join(F.broadcast(last), F.col("snapshot_date") == F.col("last")).drop("last").withColumn("scraped", F.col("scraped") + 1)  # one row
    return merging.coverage_history(day, today, ["league"], "snapshot_date").withColumn("snapshot_date", F.date_format("snapshot_date", "yyyy-MM-dd"))


@query("""WITH h AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS snapshot_date, count(DISTINCT o_orderpriority) AS leagues, count(DISTINCT o_custkey) AS clubs FROM orders GROUP BY 1) SELECT * FROM (SELECT * FROM h ORDER BY snapshot_date DESC LIMIT 30) ORDER BY snapshot_date""")
def coverage_trend(spark, d):
    """Q-28, O-07: the last 30 days with a snapshot, oldest first."""
    h = T(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("snapshot_date")).agg(F.countDistinct("o_orderpriority").alias("leagues"), F.countDistinct("o_custkey").alias("clubs"))
    return merging.latest_days(h, "snapshot_date", 30)


@query(f"WITH {b.CLUBS} SELECT regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, arg_min(city, id) AS city, string_agg(DISTINCT name, '|' ORDER BY name) AS aliases, string_agg(DISTINCT state, '|' ORDER BY state) AS affiliations FROM clubs GROUP BY 1")
def seed_affiliations(spark, d):
    """ER-23: clubs by slug with the sets of their spellings and affiliations."""
    found = entity.seed_clubs(b.clubs(spark, d), "name", "id", ["city"], "state")
    return found.select("slug", "city", F.array_join("aliases", "|").alias("aliases"), F.nullif(F.array_join("affiliations", "|"), F.lit("")).alias("affiliations"))


@query()
def linked_schools(spark, d):
    """ER-07: customers' school names within their state, with the pass that found them."""
    c = b.clubs(spark, d).select("id", "state", "name")
    states = c.select((F.col("id") % 997).alias("n"), "state").groupBy("n").agg(F.min("state").alias("state"))
    raw = b.link_targets(spark, d)["customers"].select("raw", (F.col("id") % 997).alias("n")).join(states, "n", "left").select("state", F.col("raw").alias("name"))
    aliases = c.where("id % 9 = 0").select("id", "state", F.concat("name", F.lit(" High")).alias("name"))
    return entity.link_schools(raw, c, aliases)


@query(f"""WITH {b.CLUBS}, c AS (SELECT id, name, state, size, {TOKENS_SQL.format('name')} AS tok, string_split(regexp_replace(lower(trim(name)), '\\s+', ' ', 'g'), ' ') AS w FROM clubs),
p AS (SELECT a.id AS a_id, b.id AS b_id, a.name AS an, b.name AS bn, a.tok AS ta, b.tok AS tb FROM c a JOIN c b ON coalesce(a.state, 'UNKNOWN') = coalesce(b.state, 'UNKNOWN') AND a.size % 2 = b.size % 2 AND a.id < b.id
    WHERE NOT (len(a.w) <> len(b.w) AND a.w[:least(len(a.w), len(b.w))] = b.w[:least(len(a.w), len(b.w))])),
s AS (SELECT a_id, b_id, 0.4 * (1 - CAST(levenshtein(lower(an), lower(bn)) AS DOUBLE) / greatest(length(an), length(bn)))
    + 0.6 * CASE WHEN len(list_distinct(list_concat(ta, tb))) = 0 THEN 1.0 ELSE CAST(len(list_intersect(ta, tb)) AS DOUBLE) / len(list_distinct(list_concat(ta, tb))) END AS similarity FROM p)
SELECT a_id, b_id, round(similarity, 4) AS similarity FROM s WHERE similarity >= 0.92""".replace("\\\\", "\\"))
def college_pairs(spark, d):
    """ER-10, J-08: pairs of a division and gender at 0.92 or more; a name that extends another is none."""
    c = b.clubs(spark, d).select("id", "name", "state", "size")
    found = entity.duplicate_pairs(c, "id", "name", [F.upper(F.coalesce("state", F.lit("UNKNOWN"))), F.col("size") % 2], 0.92, skip_extensions=True)
    return found.select("a_id", "b_id", F.round("similarity", 4).alias("similarity"))

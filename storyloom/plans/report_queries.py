"""Archive, reports, sequences, graphs, vectors and streams over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom.operators import archive, graph, linking, ordering, reports, semantic, surfaces
from storyloom.plans.registry import query
from storyloom.sources import feeds
from storyloom.sources import pages as page
from storyloom.sources.tables import table
from storyloom.streaming import flows

SPLIT = "1997-01-01"
DAY = "1998-01-01 00:00:00"


def generations(spark, sf_dir):
    """Orders seen twice: before a date, and after it with some of them changed."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp")).select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("timestamp").alias("first_seen"), F.col("o_orderdate").cast("timestamp").alias("last_modified")
    )
    new = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").alias("price"))
    return old, new


_GEN = f"""p AS (SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS first_seen, o_orderdate AS last_modified FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT}'),
c AS (SELECT o_orderkey AS key, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price, true AS live FROM orders WHERE o_orderstatus <> 'P')"""


@query(f"""WITH {_GEN}, j AS (SELECT key, c.live, p.first_seen, p.last_modified, p.status AS ps, c.status AS cs, p.price AS pp, c.price AS cp FROM p FULL JOIN c USING (key))
SELECT key, CASE WHEN live THEN cs ELSE ps END AS status, CASE WHEN live THEN cp ELSE pp END AS price, coalesce(first_seen, TIMESTAMP '{DAY}')::VARCHAR AS first_seen,
 CASE WHEN first_seen IS NULL OR (live AND (ps IS DISTINCT FROM cs OR pp IS DISTINCT FROM cp)) THEN TIMESTAMP '{DAY}' ELSE last_modified END::VARCHAR AS last_modified,
 CASE WHEN first_seen IS NULL THEN 'insert' WHEN live AND (ps IS DISTINCT FROM cs OR pp IS DISTINCT FROM cp) THEN 'update' ELSE 'keep' END AS action FROM j""")
def archive_upsert(spark, sf_dir):
    old, new = generations(spark, sf_dir)
    out = archive.upsert(old, new, "key", ["status", "price"], F.lit(DAY).cast("timestamp"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_modified")})


@query(f"WITH {_GEN} SELECT key FROM c WHERE key NOT IN (SELECT key FROM p)")
def new_ids(spark, sf_dir):
    old, new = generations(spark, sf_dir)
    return archive.new_ids(new, old, "key")


@query(f"WITH {_GEN} SELECT key, status FROM p WHERE key NOT IN (SELECT key FROM c)")
def carry_over(spark, sf_dir):
    old, new = generations(spark, sf_dir)
    return archive.carry_over(old, new, "key").select("key", "status")


@query(f"""WITH {_GEN}, j AS (SELECT key, p.status AS a, c.status AS b, floor(p.price / 1000)::BIGINT AS x, floor(c.price / 1000)::BIGINT + (key % 5 = 0)::INT AS y FROM p JOIN c USING (key)),
e AS (SELECT key, 'headline_updated' AS kind, a AS old, b AS new FROM j UNION ALL SELECT key, 'coverage_change', x::VARCHAR, y::VARCHAR FROM j UNION ALL SELECT key, 'category_changed', CASE WHEN key % 11 > 0 THEN 'a' END, CASE WHEN key % 11 = 0 OR key % 13 = 0 THEN 'b' ELSE 'a' END FROM j)
SELECT key, kind, old, new FROM e WHERE old IS DISTINCT FROM new""")
def history_events(spark, sf_dir):
    """All three kinds: other states, one more source for some, other or first categories for some."""
    old, new = generations(spark, sf_dir)
    more = lambda later: F.floor(F.col("price") / 1000) + ((F.col("key") % 5 == 0).cast("int") if later else F.lit(0))
    category = lambda later: F.when((F.col("key") % 11 == 0) | (F.col("key") % 13 == 0), "b").otherwise("a") if later else F.when(F.col("key") % 11 > 0, "a")
    side = lambda x, later=False: x.select("key", F.col("status").alias("title"), more(later).alias("source_count"), category(later).alias("category"))
    return archive.diff(side(old), side(new, True), "key", F.lit(DAY)).select("key", "kind", "old", "new")


@query(f"""WITH s AS (SELECT l_orderkey AS key, l_suppkey AS url, min(l_shipdate) AS fs, max(l_shipdate) AS ls FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT}' GROUP BY ALL),
a AS (SELECT DISTINCT l_orderkey AS key, l_suppkey AS url FROM lineitem WHERE l_linenumber <= 2)
SELECT key, url, coalesce(fs, TIMESTAMP '{DAY}')::VARCHAR AS first_seen, CASE WHEN a.key IS NOT NULL THEN TIMESTAMP '{DAY}' ELSE ls END::VARCHAR AS last_seen
FROM s FULL JOIN a USING (key, url)""")
def source_union(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("url"), F.col("l_shipdate").cast("timestamp").alias("at"), "l_linenumber")
    stored = lines.where(F.col("at") < F.lit(SPLIT).cast("timestamp")).groupBy("key", "url").agg(F.lit("s").alias("name"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    active = lines.where("l_linenumber <= 2").select("key", "url").distinct().withColumn("name", F.lit("a"))
    out = archive.source_union(stored, active, F.lit(DAY).cast("timestamp"))
    return out.select("key", "url", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")))


@query("""WITH v AS (SELECT l_orderkey AS node, l_suppkey AS url FROM lineitem WHERE l_linestatus = 'F'), u AS (SELECT DISTINCT l_suppkey AS url, l_suppkey % 7 AS target FROM lineitem),
n AS (SELECT node, target, count(*) AS votes FROM v JOIN u USING (url) GROUP BY ALL) SELECT node, target, votes FROM n QUALIFY row_number() OVER (PARTITION BY node ORDER BY votes DESC, target) = 1""")
def merge_votes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    vanished = lines.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("url"))
    urls = lines.select(F.col("l_suppkey").alias("url"), (F.col("l_suppkey") % 7).alias("target")).distinct()
    return archive.merges(vanished, urls)


def _chains(spark, sf_dir):
    """Each order and the one before it of the same customer."""
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), before.alias("b")).where("b IS NOT NULL")


@query("""SELECT o_orderkey AS node, f AS target FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders) WHERE o_orderkey <> f""")
def pointer_flatten(spark, sf_dir):
    """Chains of merge pointers, one hop each afterwards."""
    return graph.flatten_pointers(_chains(spark, sf_dir).select(F.col("a").alias("node"), F.col("b").alias("target")))


@query("""SELECT o_orderkey AS node, f AS label FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1""")
def connected_components(spark, sf_dir):
    return graph.components(_chains(spark, sf_dir))


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 20""")
def last_20_history(spark, sf_dir):
    return archive.last_events(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query("""WITH c AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events),
n AS (SELECT user_id, event_type, count(*) AS n FROM c WHERE l IS NULL OR l <> event_type GROUP BY ALL HAVING count(*) > 1) SELECT user_id, sum(n - 1)::BIGINT AS returns FROM n GROUP BY user_id""")
def flap_detect(spark, sf_dir):
    return reports.flaps(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query()
def churn_cancel(spark, sf_dir):
    """Each user's value changes as coverage changes, without those taken back within a day."""
    rows = table(spark, sf_dir, "events")
    event = F.struct(F.when(F.col("event_type") == "error", "category_changed").otherwise("coverage_change").alias("kind"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3).cast("string").alias("old"), (F.col("event_id") % 2).cast("string").alias("new"))
    kept = rows.groupBy("user_id").agg(F.collect_list(event).alias("h"))
    return kept.select("user_id", F.size("h").alias("n_events"), F.size(archive.without_churn("h")).alias("n_kept"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n, min(ts) OVER (PARTITION BY user_id) AS f FROM events)
SELECT user_id, greatest(0, floor(epoch_us(ts - f) / 6e7 + 0.5))::BIGINT AS minutes FROM f WHERE n = 5""")
def velocity_to_n(spark, sf_dir):
    return reports.velocity_to(table(spark, sf_dir, "events"), "user_id", "ts", 5)


@query("""SELECT user_id, count_if(ts <= f + INTERVAL 24 HOURS) AS n FROM (SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id) AS f FROM events) GROUP BY user_id""")
def pickup_24h(spark, sf_dir):
    return reports.pickup(table(spark, sf_dir, "events"), "user_id", "ts")


@query("""SELECT user_id, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value, arg_max(value, ts) > arg_min(value, ts) AS grew FROM events GROUP BY user_id""")
def first_last_growth(spark, sf_dir):
    return reports.growth(table(spark, sf_dir, "events"), "user_id", "ts", "value")


def _counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n"))


_PCT = "floor(count_if({0}) / count(*) * 1000 + 0.5) / 10"


@query(f"""WITH c AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS stories, count_if(n = 1) AS one, count_if(n = 2) AS two, count_if(n = 3) AS three, count_if(n >= 4) AS four_up, {_PCT.format('n = 1')} AS one_pct, {_PCT.format('n = 2')} AS two_pct,
 {_PCT.format('n = 3')} AS three_pct, {_PCT.format('n >= 4')} AS four_up_pct, {_PCT.format('n >= 2')} AS multi_pct, quantile_cont(n, 0.5)::DOUBLE AS median, floor(avg(n) * 100 + 0.5) / 100 AS mean FROM c""")
def coverage_distribution(spark, sf_dir):
    return reports.coverage(_counts(spark, sf_dir), "n")


@query("""WITH c AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), s AS (SELECT o_orderstatus, n FROM orders JOIN c ON l_orderkey = o_orderkey)
SELECT o_orderstatus, quantile_disc(n, 0.9)::BIGINT AS p90, quantile_cont(n, 0.5)::DOUBLE AS median FROM s GROUP BY 1""")
def nearest_rank_p90(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(_counts(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_orderstatus").agg(F.expr("cast(percentile_disc(0.9) WITHIN GROUP (ORDER BY n) AS long)").alias("p90"), F.percentile("n", F.lit(0.5)).alias("median"))


@query("""WITH s AS (SELECT l_orderkey AS story, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), c AS (SELECT l_suppkey AS k, count(*) AS a, count_if(n >= 2) AS m FROM lineitem JOIN s ON l_orderkey = story WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s_suppkey, coalesce(a, 0) AS articles, coalesce(m, 0) AS shared, CASE WHEN coalesce(a, 0) = 0 THEN 0 ELSE floor(m / a * 1000 + 0.5) / 1000 END AS shared_rate,
 CASE WHEN coalesce(a, 0) = 0 THEN 0 ELSE floor(m / a * 1000 + 0.5) / 10 END AS shared_pct FROM supplier LEFT JOIN c ON k = s_suppkey""")
def feed_value(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_orderkey").alias("story"))
    stories = _counts(spark, sf_dir).select(F.col("l_orderkey").alias("story"), F.col("n").alias("source_count"))
    return reports.feed_value(table(spark, sf_dir, "supplier"), lines, stories, "s_suppkey")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


@query(f"""WITH v AS (SELECT unnest({_PRIORITIES}) AS label, unnest(range(6))::INT AS pos), c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1)
SELECT pos, label, coalesce(n, 0) AS n, floor(coalesce(n, 0) / (SELECT count(*) FROM orders) * 1000 + 0.5) / 10 AS pct FROM v LEFT JOIN c USING (label)""")
def category_mix_zero_filled(spark, sf_dir):
    return reports.mix(table(spark, sf_dir, "orders"), "o_orderpriority", _PRIORITIES)


@query("""SELECT c_name AS name, count(DISTINCT o_orderdate) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def publisher_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return reports.publishers(rows, "o_orderdate", "c_name")


@query("""SELECT l_orderkey, arg_min(l_suppkey::VARCHAR, (l_shipdate, l_suppkey::VARCHAR)) AS first_publisher FROM lineitem GROUP BY 1""")
def earliest_publisher(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("name", F.col("l_suppkey").cast("string"))
    return reports.earliest(rows, "l_orderkey", "name", "l_shipdate").select("l_orderkey", "first_publisher")


_DAY = "(o_orderdate AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE"


@query(f"""WITH w AS (SELECT date_trunc('week', {_DAY})::DATE AS ws, count(*) AS n FROM orders GROUP BY 1)
SELECT ws::VARCHAR AS week_start, n, CASE WHEN lag(ws) OVER (ORDER BY ws) = ws - 7 THEN lag(n) OVER (ORDER BY ws) END AS previous, CASE WHEN lag(ws) OVER (ORDER BY ws) = ws - 7 THEN n - lag(n) OVER (ORDER BY ws) END AS delta FROM w""")
def week_over_week(spark, sf_dir):
    return reports.weekly(table(spark, sf_dir, "orders"), "o_orderdate").select(F.col("week_start").cast("string").alias("week_start"), "n", "previous", "delta")


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS level, count(DISTINCT l_suppkey) AS items, sum(l_quantity) AS weight,
 floor(sum(l_quantity * l_linenumber) / sum(l_quantity) * 10000 + 0.5) / 10000 AS position FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))""")
def grouping_total_detail(spark, sf_dir):
    out = reports.grouping(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "l_linenumber", "l_suppkey")
    return out.withColumn("level", F.col("level").cast("long"))


@query("""WITH c AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, sum(l_quantity) AS w FROM lineitem GROUP BY 1),
b AS (SELECT unnest(list_filter([CASE WHEN n >= 4 THEN '4+' ELSE n::VARCHAR END, CASE WHEN n >= 2 THEN '2+' END, CASE WHEN n >= 3 THEN '3+' END], lambda x : x IS NOT NULL)) AS bucket, w FROM c) SELECT bucket, count(*) AS rows, sum(w) AS weight FROM b GROUP BY 1""")
def overlapping_buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n"), F.sum("l_quantity").alias("w"))
    return reports.overlapping(rows, "n", "w")


@query(f"""WITH o AS (SELECT o_custkey AS k, min(o_orderdate) AS at, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT}' GROUP BY 1), w AS (SELECT o_custkey AS k, min(o_orderdate) AS at, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT}' GROUP BY 1)
SELECT k, least(o.at, w.at)::VARCHAR AS at, greatest(o.n, w.n) AS n FROM o FULL JOIN w USING (k)""")
def ledger_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    side = lambda test: orders.where(test).groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("at"), F.count(F.lit(1)).alias("n"))
    early = F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp")
    return reports.ledger(side(early), side(~early), "k").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH x AS (SELECT l_orderkey, 'l_returnflag' AS field, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem GROUP BY 1) SELECT * FROM x WHERE n > 1""")
def coherence_check(spark, sf_dir):
    return reports.coherence(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("""SELECT count_if(quality = 1 AND length(text) > 400) AS tp, count_if(quality = 0 AND length(text) > 400) AS fp, count_if(quality = 1 AND length(text) <= 400) AS fn,
 floor(count_if(quality = 1 AND length(text) > 400) / count_if(length(text) > 400) * 10000 + 0.5) / 10000 AS precision,
 floor(count_if(quality = 1 AND length(text) > 400) / count_if(quality = 1) * 10000 + 0.5) / 10000 AS recall FROM labels JOIN documents USING (doc_id)""")
def precision_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return reports.precision_recall(rows.select((F.col("quality") == 1).alias("t"), (F.length("text") > 400).alias("f")), "t", "f")


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query(f"""SELECT a.vec_id AS query, b.vec_id, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 8""")
def cosine_top_k(spark, sf_dir):
    """Queries: every row whose id is divisible by 100; searched: all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return semantic.nearest(rows.where("vec_id % 100 = 0"), rows, 8).withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH n AS (SELECT a.vec_id AS query, b.label, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 8), v AS (SELECT query, label, round(sum(s), 6) AS weight FROM n GROUP BY ALL)
SELECT query, label, weight FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY weight DESC, label) = 1""")
def knn_vote(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return semantic.vote(semantic.nearest(rows.where("vec_id % 100 = 0"), rows, 8), rows.select("vec_id", "label"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal / 10000 >= 0.85 THEN 'BUILDING' ELSE CASE WHEN c_mktsegment = 'MACHINERY' THEN 'general' ELSE c_mktsegment END END AS category FROM customer""")
def gated_override(spark, sf_dir):
    section = F.when(F.col("c_mktsegment") == "MACHINERY", "general").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", semantic.override(section, F.lit("BUILDING"), F.col("c_acctbal") / 10000).alias("category"))


@query("""WITH s AS (SELECT user_id, event_id, ts, event_type FROM events WHERE event_type = 'purchase') SELECT e.event_id, max(s.event_id) AS purchase FROM events e JOIN s ON s.user_id = e.user_id AND s.ts < e.ts AND s.ts >= e.ts - INTERVAL 48 HOURS
WHERE e.event_type = 'error' GROUP BY 1""")
def range_join_48h(spark, sf_dir):
    """Errors with the last purchase of the same user within 48 hours: an equi-join on user and day, then the range."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    errors = rows.where("event_type = 'error'").select("event_id", "user_id", F.col("ts").alias("at"), F.explode(F.sequence(F.col("day") - 2, F.col("day"))).alias("day"))
    bought = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", "ts", "day")
    hits = errors.join(bought, ["user_id", "day"]).where("ts < at AND ts >= at - INTERVAL 48 HOURS")
    return hits.groupBy("event_id").agg(F.max("purchase").alias("purchase"))


@query("SELECT date_trunc('day', ts)::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    """A finished stream of daily windows."""
    out = flows.finished(flows.tumbling(flows.events(spark, sf_dir)), "tumbling_counts", "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


@query("""SELECT (time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k))::VARCHAR AS start, event_type, count(*) AS n FROM events CROSS JOIN range(3) r(k) GROUP BY ALL""")
def sliding_counts(spark, sf_dir):
    out = flows.finished(flows.sliding(flows.events(spark, sf_dir)), "sliding_counts", "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_spans(spark, sf_dir):
    """Sessions of each user, by the batch form of the stream's windows."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


@query("SELECT event_id FROM events")
def stream_dedupe(spark, sf_dir):
    """Every event once, however often the stream brings it."""
    rows = flows.events(spark, sf_dir)
    twice = rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return flows.finished(flows.deduplicated(twice, ["event_id"]), "stream_dedupe", "append").select("event_id")


@query()
def stateful_labels(spark, sf_dir):
    """A label per user that changes only after two equal events in a row, kept in the stream's state."""
    return flows.finished(flows.stable_labels(flows.events(spark, sf_dir)), "stateful_labels", "update").groupBy("user_id").agg(F.max_by("label", "changes").alias("label"), F.max("changes").alias("changes"))


@query("""WITH x AS (SELECT page_id, url, html FROM pages) SELECT 'feed-' || page_id % 5 AS feed_url, count(*) AS items_parsed, 0 AS items_skipped, true AS ok FROM x GROUP BY 1""")
def feed_health(spark, sf_dir):
    """Pages written as five feeds and parsed again."""
    rows = table(spark, sf_dir, "pages")
    item = F.concat(F.lit("<item><title>"), F.concat(F.lit("Page number "), F.col("page_id")), F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link><pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate></item>"))
    bodies = rows.groupBy(F.concat(F.lit("feed-"), F.col("page_id") % 5).alias("feed_url")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml"))
    out = feeds.health(bodies.select("feed_url"), feeds.items(bodies, 1 << 30))
    return out.select("feed_url", "items_parsed", F.col("items_skipped").cast("int").alias("items_skipped"), "ok")


@query("""SELECT page_id, language FROM (SELECT page_id, regexp_extract(html, '(?is)<html\\b[^>]*lang="([^"]*)"', 1) AS language FROM pages)""")
def page_languages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page.language("html").alias("language"))


@query("""SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY day DESC LIMIT 400""")
def archive_days(spark, sf_dir):
    return archive.days(table(spark, sf_dir, "orders"), "o_orderdate").withColumn("day", F.col("day").cast("string"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders""")
def global_rank(spark, sf_dir):
    return ordering.with_place(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "place")


_EVIDENCE = """f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 23 > 0 THEN o_orderkey * 37 % 3000 END AS age_hours, 1 + (o_orderkey % 9 = 0)::INT AS independent, (o_orderkey % 7 = 0)::INT AS events, (o_orderkey % 11 = 0)::INT AS details, (o_orderkey % 13 = 0)::INT AS related,
 (o_orderkey % 17 = 0)::INT AS clicks, (o_orderkey % 19 = 0)::INT AS impressions, o_orderkey % 3 > 0 AS fresh_report FROM orders),
d AS (SELECT o_orderkey, CASE WHEN age_hours IS NULL THEN 'age_unknown' WHEN age_hours <= 336 THEN 'recent' WHEN independent >= 2 THEN 'several_publications' WHEN events >= 1 THEN 'history' WHEN details >= 1 THEN 'corroborated' WHEN related >= 1 THEN 'related'
 WHEN clicks >= 1 THEN 'clicks' WHEN impressions >= 1 THEN 'impressions' WHEN NOT fresh_report THEN 'no_fresh_report' ELSE 'single_report' END AS reason FROM f)"""


@query(f"WITH {_EVIDENCE} SELECT o_orderkey, reason, reason <> 'single_report' AS index FROM d")
def index_decisions(spark, sf_dir):
    """Orders as stories with every kind of evidence; all ten reasons come up."""
    key = F.col("o_orderkey")
    flag = lambda n: (key % n == 0).cast("int")
    evidence = {"age_hours": F.when(key % 23 > 0, key * 37 % 3000), "independent": 1 + flag(9), "events": flag(7), "details": flag(11), "related": flag(13), "clicks": flag(17), "impressions": flag(19), "fresh_report": key % 3 > 0}
    rows = table(spark, sf_dir, "orders").select(key, *(v.alias(k) for k, v in evidence.items()))
    return rows.select("o_orderkey", surfaces.index_decision().alias("d")).select("o_orderkey", "d.reason", "d.index")


_CLUSTER = "'c' || substr(sha256({} || ''), 1, 12)"


def _cluster_id(key):
    return F.concat(F.lit("c"), F.substring(F.sha2(key.cast("string"), 256), 1, 12))


@query(f"""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 7 AS m, {_CLUSTER.format('o_orderkey')} AS id FROM orders)
SELECT CASE WHEN m = 5 THEN 'page-' || k ELSE 'title-' || id END AS slug, CASE m WHEN 0 THEN 'live' WHEN 1 THEN 'redirect' WHEN 2 THEN 'archived' WHEN 3 THEN 'merged' WHEN 4 THEN 'unavailable' WHEN 5 THEN 'not-found' ELSE 'live' END AS outcome,
 CASE WHEN m IN (0, 1, 2, 6) THEN id WHEN m = 3 THEN {_CLUSTER.format('(k - 3)')} END AS cluster_id FROM r""")
def story_resolution(spark, sf_dir):
    """Orders as requested stories: live ones under their own or another title, archived, merged and vanished ones, and addresses of none; all six outcomes come up."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (key % 7).alias("m"), _cluster_id(key).alias("cluster_id"))
    asked = rows.select(F.when(F.col("m") == 5, F.concat(F.lit("page-"), key)).otherwise(F.concat(F.lit("title-"), F.col("cluster_id"))).alias("slug"))
    title = F.when(F.col("m") == 1, "changed-").otherwise("title-")
    live = rows.where("m IN (0, 1, 6)").select("cluster_id", F.concat(title, F.col("cluster_id")).alias("slug"))
    # What has merged is in the archive as well; the pointer counts.
    old = rows.where("m IN (1, 2, 3)").select("cluster_id", F.concat(F.lit("old-"), F.col("cluster_id")).alias("slug"))
    pointers = rows.where("m = 3").select(F.col("cluster_id").alias("node"), _cluster_id(key - 3).alias("target"))
    return surfaces.resolve(asked, live, old, pointers).select("slug", "outcome", "cluster_id")


@query()
def inherited_ids(spark, sf_dir):
    """Suppliers' groups of orders take the ids of last year's groups by shared customers, one to one."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), (F.col("o_orderkey") % 20).alias("grp"), "o_orderdate")
    old = rows.where(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp")).select("url", F.concat(F.lit("c"), F.col("grp") % 15).alias("cluster_id")).distinct()
    return linking.inherit_ids(rows.where(F.col("o_orderdate") >= F.lit(SPLIT).cast("timestamp")).select("grp", "url").distinct(), old)

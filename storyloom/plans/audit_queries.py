"""Archive rows in JSON, audits, discovery and samples over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom import config
from storyloom.checkpoints import checkpoint

from storyloom.operators import audits, discovery, json_history, linking
from storyloom.plans.registry import query
from storyloom.plans.text_queries import _TOKENS
from storyloom.sources.tables import ARTICLES_SQL, articles, table


#: Lines that one task gathers to orders.
LINES = 200_000


def archived(spark, sf_dir):
    """Orders as archive rows: their lines as JSON of sources and of history, some of it malformed."""
    line = F.struct("l_linenumber", "l_suppkey", "l_returnflag", F.floor("l_quantity").alias("q"))
    items = table(spark, sf_dir, "lineitem")
    # Lists are gathered in memory, so the number of tasks follows the table and not the session.
    dealt = items.repartition(max(spark.sparkContext.defaultParallelism, -(-items.count() // LINES)), "l_orderkey")
    lines = dealt.groupBy(F.col("l_orderkey").alias("key")).agg(F.sort_array(F.collect_list(line)).alias("lines"))  # a few for each order

    def source(x):
        name = F.when(x["l_linenumber"] == 4, "  ").otherwise(F.concat(F.lit(" supp "), (x["l_suppkey"] % 5).cast("string")))
        return F.concat(F.lit('{"name":"'), name, F.lit('"'), F.when(x["l_returnflag"] == "R", ',"firstSeenAt":null').otherwise(""), F.lit("}"))

    def event(x):
        kind = F.when(x["l_returnflag"] == "N", "headline_updated").otherwise("coverage_change")
        to = F.when(x["l_linenumber"] == 2, "many").otherwise((x["q"] + 1).cast("string"))
        return F.concat(F.lit('{"kind":"'), kind, F.lit('","from":'), x["q"].cast("string"), F.lit(',"to":"'), to, F.lit('"}'))

    listed = lambda f: F.concat(F.lit("["), F.array_join(F.transform("lines", f), ","), F.lit("]"))
    key = F.col("key")
    broken = F.when(key % 17 == 0, '{"name":"x"}').when(key % 19 == 0, '[{"name":').when(key % 23 != 0, listed(source))
    return lines.select("key", (key % 4).cast("int").alias("source_count"), (key % 29 == 0).alias("merged"), broken.alias("sources"), F.when(key % 31 == 0, "7").otherwise(listed(event)).alias("history"))


_ARCHIVED = """r AS (SELECT l_orderkey AS key, CAST(l_orderkey % 4 AS INTEGER) AS source_count, l_orderkey % 29 = 0 AS merged,
 CASE WHEN l_orderkey % 17 = 0 THEN '{"name":"x"}' WHEN l_orderkey % 19 = 0 THEN '[{"name":' WHEN l_orderkey % 23 <> 0 THEN '[' || string_agg('{"name":"' || CASE WHEN l_linenumber = 4 THEN '  ' ELSE ' supp ' || (l_suppkey % 5) END || '"'
  || CASE WHEN l_returnflag = 'R' THEN ',"firstSeenAt":null' ELSE '' END || '}', ',' ORDER BY l_linenumber, l_suppkey, l_returnflag, floor(l_quantity)) || ']' END AS sources,
 CASE WHEN l_orderkey % 31 = 0 THEN '7' ELSE '[' || string_agg('{"kind":"' || CASE WHEN l_returnflag = 'N' THEN 'headline_updated' ELSE 'coverage_change' END || '","from":' || floor(l_quantity)::BIGINT
  || ',"to":"' || CASE WHEN l_linenumber = 2 THEN 'many' ELSE (floor(l_quantity)::BIGINT + 1)::VARCHAR END || '"}', ',' ORDER BY l_linenumber, l_suppkey, l_returnflag, floor(l_quantity)) || ']' END AS history FROM lineitem GROUP BY l_orderkey),
e AS (SELECT *, CASE WHEN json_valid(sources) THEN CASE WHEN json_type(sources) = 'ARRAY' THEN json_extract(sources, '$[*]') ELSE [] END ELSE [] END AS s, CASE WHEN json_type(history) = 'ARRAY' THEN json_extract(history, '$[*]') ELSE [] END AS h FROM r),
u AS (SELECT key, source_count, merged, CAST(len(s) AS INTEGER) AS union_sources, CAST(len(list_distinct(list_filter(list_transform(s, lambda x : nullif(trim(x ->> '$.name'), '')), lambda n : n IS NOT NULL))) AS INTEGER) AS union_publications,
 len(list_filter(s, lambda x : json_exists(x, '$.firstSeenAt'))) > 0 AS stamped,
 list_max(flatten(list_transform(list_filter(h, lambda x : x ->> '$.kind' = 'coverage_change'), lambda x : [CASE WHEN regexp_matches(x ->> '$.from', '^[0-9]+$') THEN TRY_CAST(x ->> '$.from' AS INTEGER) END, CASE WHEN regexp_matches(x ->> '$.to', '^[0-9]+$') THEN TRY_CAST(x ->> '$.to' AS INTEGER) END]))) AS peak_history,
 CAST(len(h) AS INTEGER) AS history_events FROM e)"""


@query(f"WITH {_ARCHIVED} SELECT key, union_sources, union_publications, stamped, peak_history, history_events FROM u")
def archive_unions(spark, sf_dir):
    return json_history.union_rows(archived(spark, sf_dir)).select("key", "union_sources", "union_publications", "stamped", "peak_history", "history_events")


@query(f"WITH {_ARCHIVED}, x AS (SELECT key, unnest(h) AS v, unnest(range(len(h))) AS pos FROM e) SELECT key, CAST(pos AS INTEGER) AS pos, v ->> '$.kind' AS kind, v ->> '$.from' AS from_, v ->> '$.to' AS to_ FROM x")
def archive_history(spark, sf_dir):
    return json_history.events(archived(spark, sf_dir), "key").select("key", "pos", "kind", F.col("from").alias("from_"), F.col("to").alias("to_"))


@query(f"WITH {_ARCHIVED}, x AS (SELECT key, unnest(s) AS v, unnest(range(len(s))) AS pos FROM e) SELECT key, CAST(pos AS INTEGER) AS pos, v ->> '$.name' AS name FROM x")
def archive_references(spark, sf_dir):
    return json_history.references(archived(spark, sf_dir), "key").select("key", "pos", "name")


def _share(test: str, name: str) -> str:
    return f"count_if(NOT merged AND {test}) AS n_{name}, CASE WHEN count_if(NOT merged) > 0 THEN floor(count_if(NOT merged AND {test}) / count_if(NOT merged) * 1000 + 0.5) / 10 ELSE 0 END AS pct_{name}"


@query(f"""WITH {_ARCHIVED} SELECT count_if(NOT merged) AS n_rows, count_if(merged) AS n_merged, {_share('stamped', 'stamped')}, {_share('union_publications > source_count', 'union_above')}, {_share('coalesce(peak_history > source_count, false)', 'peak_above')},
 {_share('source_count >= 2', 'multi_by_count')}, {_share('union_publications >= 2', 'multi_by_union')}, {_share('greatest(source_count, union_publications, coalesce(peak_history, 0)) >= 2', 'multi_by_most')} FROM u""")
def union_audit(spark, sf_dir):
    return audits.union_summary(json_history.union_rows(archived(spark, sf_dir)))


SEED = 20260828


@query(f"""WITH {_ARCHIVED}, l AS (SELECT key, union_publications >= 2 AS many, ('0x' || substr(sha256('{SEED}:' || key), 1, 15))::BIGINT AS h FROM u WHERE NOT merged), c AS (SELECT count_if(many) AS m, count_if(NOT many) AS s FROM l),
q AS (SELECT m, least(s, 200 - least(m, 100)) AS singles FROM c), n AS (SELECT least(m, 200 - singles) AS multi, singles FROM q), o AS (SELECT *, row_number() OVER (PARTITION BY many ORDER BY h, key) AS i FROM l)
SELECT key, many FROM o, n WHERE i <= CASE WHEN many THEN multi ELSE singles END""")
def audit_sample(spark, sf_dir):
    rows = json_history.union_rows(archived(spark, sf_dir)).where("NOT merged")
    return audits.balanced_sample(rows, F.col("union_publications") >= 2, "key", 200, SEED).select("key", F.col("_many").alias("many"))


@query(f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ('0x' || substr(sha256('{SEED}:' || o_orderkey), 1, 15))::BIGINT, o_orderkey) AS i FROM orders) WHERE i <= CASE o_orderpriority WHEN '1-URGENT' THEN 40 ELSE 25 END")
def stratified_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    quotas = orders.select("o_orderpriority").distinct().withColumn("k", F.when(F.col("o_orderpriority") == "1-URGENT", 40).otherwise(25))
    return audits.bottom_k(orders, "o_orderpriority", quotas, "o_orderkey", SEED).select("o_orderkey", "o_orderpriority")


def _draw_sql(n: str) -> str:
    return f"""a AS (SELECT doc_id, ({SEED}::HUGEINT + {n}::HUGEINT * {0x6D2B79F5}) % 4294967296 AS a FROM documents), b AS (SELECT doc_id, a::BIGINT AS a FROM a),
c AS (SELECT doc_id, ((xor(a, a >> 15)::HUGEINT * (a | 1)) % 4294967296)::BIGINT AS t FROM b), d AS (SELECT doc_id, xor(t, ((t + (xor(t, t >> 7)::HUGEINT * (t | 61)) % 4294967296) % 4294967296)::BIGINT) AS t FROM c)"""


@query(f"WITH {_draw_sql('(doc_id + 1)')} SELECT doc_id, round(xor(t, t >> 14) / 4294967296, 9) AS draw FROM d")
def seeded_draws(spark, sf_dir):
    """The generator's numbers in the order of doc_id, each worked out by itself."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(audits.draw(SEED, F.col("doc_id") + 1), 9).alias("draw"))


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT l.event_id, r.event_id AS view_id, strftime(r.ts, '%Y-%m-%d %H:%M:%S.%f') AS viewed_at FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def last_view_before(spark, sf_dir):
    """For each purchase the user's last view before it."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = discovery.asof(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), events.where("event_type = 'view'"), "user_id", "ts", ["event_id"])
    return found.select("event_id", F.col("right_event_id").alias("view_id"), F.date_format("right_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("viewed_at"))


DISCOVERY_DAY, DISCOVERY_WINDOW = "1998-06-01 12:00:00", 900


@query(f"""WITH f AS (SELECT l_orderkey AS id, min(l_shipdate)::DATE AS day FROM lineitem WHERE l_quantity > 5 GROUP BY ALL),
j AS (SELECT o_orderkey, greatest(0, epoch_us((day + 1)::TIMESTAMP) - epoch_us(o_orderdate)) / 3.6e9 AS h FROM orders LEFT JOIN f ON id = o_orderkey
 WHERE o_orderdate >= TIMESTAMP '{DISCOVERY_DAY}' - INTERVAL {DISCOVERY_WINDOW} DAY AND o_orderdate <= TIMESTAMP '{DISCOVERY_DAY}' - INTERVAL 72 HOUR)
SELECT count(*) AS eligible, count(h) AS discovered, floor(count(h) / count(*) * 1000 + 0.5) / 10 AS discovered_pct, {', '.join(f"floor(count_if(h <= {n}) / count(*) * 1000 + 0.5) / 10 AS within_{n}h_pct" for n in (24, 48, 72))},
 CAST(floor(median(h) + 0.5) AS BIGINT) AS median_hours FROM j""")
def early_discovery(spark, sf_dir):
    """Orders as stories, the days of their shipments as days with impressions."""
    ledger = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("published_at"))
    days = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("day"), (F.col("l_quantity") - 5).alias("impressions"))
    return discovery.early_discovery(ledger, days, F.lit(DISCOVERY_DAY).cast("timestamp"), DISCOVERY_WINDOW)


def known_publications(spark, sf_dir):
    """Customers' open orders as the live counts, all of their orders as the archive, some customers as the ledger."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    live = orders.where("o_orderstatus = 'O' AND o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    every = orders.where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("id"))
    stored = every.agg(F.count_if(F.col("o_orderstatus") == "F").alias("source_count"), F.count_distinct("o_orderpriority").alias("union_publications"), F.when(F.first("o_custkey") % 7 > 0, F.max(F.month(F.col("o_orderdate").cast("timestamp")) % 5)).alias("peak_history"))
    ledger = customers.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 6).alias("n"))
    return discovery.publications(live, stored, ledger)


_PUBLICATIONS = """a AS (SELECT o_custkey AS id, greatest(count_if(o_orderstatus = 'F'), count(DISTINCT o_orderpriority), CASE WHEN o_custkey % 7 > 0 THEN max(month(o_orderdate) % 5) ELSE 0 END) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey),
p AS (SELECT id, CAST(max(n) AS BIGINT) AS publications FROM (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 = 0 GROUP BY 1 UNION ALL SELECT id, n FROM a UNION ALL SELECT c_custkey, c_custkey % 6 FROM customer WHERE c_custkey % 5 = 0) GROUP BY id)"""


@query(f"WITH {_PUBLICATIONS} SELECT id, publications FROM p")
def publications_ever(spark, sf_dir):
    return known_publications(spark, sf_dir)


def page_rows(spark, sf_dir):
    """Orders as pages of their customers' stories; some belong to none."""
    orders = table(spark, sf_dir, "orders")
    story = F.when(F.col("o_orderkey") % 13 > 0, F.col("o_custkey"))
    return orders.select(F.col("o_orderkey").alias("url"), story.alias("id"), F.floor(F.col("o_totalprice") / 1000).alias("impressions"), (F.col("o_orderkey") % 4).alias("clicks"), (F.col("o_orderkey") % 50 + 1).cast("double").alias("position"))


_PAGES = "g AS (SELECT o_orderkey AS url, CASE WHEN o_orderkey % 13 > 0 THEN o_custkey END AS id, floor(o_totalprice / 1000)::BIGINT AS impressions, o_orderkey % 4 AS clicks, o_orderkey % 50 + 1 AS position FROM orders)"


@query(f"""WITH {_PUBLICATIONS}, {_PAGES}, k AS (SELECT g.*, unnest(CASE WHEN publications IS NULL THEN ['unknown'] WHEN publications <= 1 THEN ['1'] WHEN publications = 2 THEN ['2', '2+'] WHEN publications = 3 THEN ['3', '2+', '3+'] ELSE ['4+', '2+', '3+'] END) AS bucket FROM g LEFT JOIN p USING (id) WHERE id IS NOT NULL)
SELECT bucket, count(DISTINCT url) AS urls, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, round(sum(clicks) / sum(impressions), 6) AS ctr, round(sum(position * impressions) / sum(impressions), 6) AS position FROM k GROUP BY bucket""")
def pages_by_publications(spark, sf_dir):
    return discovery.by_publications(page_rows(spark, sf_dir), known_publications(spark, sf_dir))


@query(f"WITH {_PAGES} SELECT id, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(row_number() OVER (ORDER BY sum(impressions) DESC, sum(clicks) DESC, id) AS INTEGER) AS rank FROM g WHERE id IS NOT NULL GROUP BY id HAVING sum(impressions) >= 50 QUALIFY rank <= 500")
def story_signals(spark, sf_dir):
    return discovery.story_signals(page_rows(spark, sf_dir), 50, 500)


COMMON_NAMES = 12


def leading(spark, sf_dir):
    """The first article of each title, its features without stems, which SQL has none of; single: the title's only article."""
    rows = articles(spark, sf_dir).where("title <> ''")
    first = rows.groupBy("title").agg(F.min("ord").alias("ord"), (F.count(F.lit(1)) == 1).alias("single")).select("ord", "single")
    plain = linking.features(rows.join(first, "ord"))
    return checkpoint(linking.weighing(plain.withColumn("terms", F.col("tokens"))))


_LEADING = f"""l AS (SELECT *, count(*) OVER (PARTITION BY title) = 1 AS single FROM articles WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY title ORDER BY ord) = 1),
f AS (SELECT ord, single, domain, published_at, list_distinct({_TOKENS.format('title')}) AS tokens, CASE WHEN len({_TOKENS.format('title')}) > 1 THEN list_distinct(list_transform(range(1, len({_TOKENS.format('title')})), lambda i : ({_TOKENS.format('title')})[i] || ' ' || ({_TOKENS.format('title')})[i + 1])) ELSE [] END AS bigrams,
  list_distinct(list_transform(entities, lambda e : lower(e))) AS names FROM l),
n AS (SELECT count(*) AS n FROM f), t AS (SELECT ord, unnest(tokens) AS term FROM f), df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
w AS (SELECT ord, term, ln(1 + n / df) AS w, df <= greatest({config.RARE_FLOOR}, ceil(n * {config.RARE_SHARE})) AS rare FROM t JOIN df USING (term), n), z AS (SELECT ord, sum(w) AS z FROM w GROUP BY ord),
generic AS (SELECT list(name) AS g FROM (SELECT name FROM (SELECT unnest(names) AS name FROM f) GROUP BY name ORDER BY count(*) DESC, name LIMIT {COMMON_NAMES})),
x AS (SELECT a.ord AS a, b.ord AS b, sum(a.w) AS bw, count_if(a.rare) AS stems FROM w a JOIN w b USING (term) WHERE a.ord <> b.ord GROUP BY a.ord, b.ord),
j AS (SELECT p.ord AS a, q.ord AS b, len(list_filter(list_intersect(p.names, q.names), lambda e : NOT list_contains(g, e))) AS names, abs(epoch_us(p.published_at) - epoch_us(q.published_at)) / 3.6e9 AS hours,
 0.5 * (CASE WHEN len(p.tokens) = 0 OR len(q.tokens) = 0 THEN 0 ELSE len(list_intersect(p.tokens, q.tokens)) / len(list_distinct(p.tokens || q.tokens)) END) + 0.3 * (CASE WHEN len(p.bigrams) = 0 OR len(q.bigrams) = 0 THEN 0 ELSE len(list_intersect(p.bigrams, q.bigrams)) / len(list_distinct(p.bigrams || q.bigrams)) END)
 + 0.2 * (CASE WHEN len(p.names) = 0 OR len(q.names) = 0 THEN 0 ELSE len(list_intersect(p.names, q.names)) / len(list_distinct(p.names || q.names)) END) AS headline
 FROM f p JOIN f q ON p.single AND p.ord <> q.ord AND p.domain <> q.domain AND abs(epoch_us(p.published_at) - epoch_us(q.published_at)) <= {config.PAIR_HOURS} * 3600000000, generic),
k AS (SELECT j.*, coalesce(stems, 0) AS stems, round(greatest(headline, coalesce(bw / (u.z + v.z - bw), 0)) + 0.05 * coalesce(stems, 0), 4) AS score FROM j LEFT JOIN x USING (a, b) LEFT JOIN z u ON u.ord = a LEFT JOIN z v ON v.ord = b WHERE coalesce(stems, 0) > 0 OR names > 0 OR headline >= {audits.LEAST_HEADLINE}),
best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, hours, b) <= {audits.PER_STORY}),
once AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY a) = 1 ORDER BY score DESC, hours, a, b LIMIT {audits.GLOBAL_CAP})"""


def _near_misses(spark, sf_dir):
    leads = leading(spark, sf_dir)
    generic = leads.select(F.explode("names").alias("name")).groupBy("name").count().orderBy(F.desc("count"), "name").limit(COMMON_NAMES)
    return audits.near_misses(leads, generic)


@query(f"WITH {ARTICLES_SQL}, {_LEADING} SELECT a, b, CAST(stems AS INTEGER) AS stems, CAST(names AS INTEGER) AS names, score FROM once")
def near_miss_pairs(spark, sf_dir):
    return _near_misses(spark, sf_dir).select("a", "b", "stems", "names", "score")


@query(f"WITH {ARTICLES_SQL}, {_LEADING}, h AS (SELECT floor(score / 0.1 + 1e-9) AS i, count(*) AS n FROM once GROUP BY 1) SELECT printf('%.1f', i * 0.1) || '-' || printf('%.1f', i * 0.1 + 0.1) AS bin, n FROM h")
def near_miss_histogram(spark, sf_dir):
    return audits.histogram(_near_misses(spark, sf_dir), "score")

"""Ingestion, linking, stories, surfaces and topics over documents as articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom import config
from storyloom.checkpoints import checkpoint, stored
from storyloom.functions import classify, scores, text
from storyloom.operators import ingest, linking, ordering, stories, surfaces, topics
from storyloom.plans.registry import query
from storyloom.plans.text_queries import _TOKENS
from storyloom.sources.tables import ARTICLES_SQL, NOW, articles, table

def now():
    return F.lit(NOW).cast("timestamp")


_built: dict = {}


def built(spark, sf_dir):
    """(articles with grp, ranked stories) of a folder, linked once for each session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built.clear()
        # Linking and ranking ask whether there is a description and whether it is longer than 40, so that no step carries whole texts.
        rows = ingest.dedupe(articles(spark, sf_dir).drop("text").withColumn("description", F.substring("description", 1, 41)))
        members = stored(linking.cluster(rows))
        _built[key] = members, stored(stories.ranked(stories.build(members, now()), now()))
    return _built[key]


@query(f"WITH {ARTICLES_SQL} SELECT id, ord FROM articles QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY ord) = 1")
def first_wins_dedupe(spark, sf_dir):
    return ingest.dedupe(articles(spark, sf_dir)).select("id", "ord")


@query(f"WITH {ARTICLES_SQL}, top AS (SELECT id FROM articles ORDER BY published_at DESC, ord LIMIT {config.ARTICLE_CAP}) SELECT id, ord FROM articles WHERE id IN (SELECT id FROM top)")
def newest_cap(spark, sf_dir):
    return ingest.newest(articles(spark, sf_dir)).select("id", "ord")


@query(f"WITH {ARTICLES_SQL} SELECT ord FROM articles WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 72 HOURS")
def age_window(spark, sf_dir):
    return ingest.within_age(articles(spark, sf_dir), now()).select("ord")


@query(f"""WITH {ARTICLES_SQL}, h AS (SELECT epoch_us(TIMESTAMP '{NOW}' - published_at) / 3.6e9 AS h FROM articles)
SELECT count(*) AS n, round(quantile_disc(h, 0.5), 4) AS p50, round(quantile_disc(h, 0.9), 4) AS p90 FROM h""")
def age_metrics(spark, sf_dir):
    return ingest.age_metrics(articles(spark, sf_dir), now())


@query()
def normalised_pages(spark, sf_dir):
    """Pages through the whole row normalisation: title, text and address as a provider would give them."""
    pages = table(spark, sf_dir, "pages")
    raw = pages.select(
        F.col("page_id").alias("ord"),
        F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"),
        "url",
        F.regexp_extract("url", "//([^/]+)", 1).alias("source"),
        F.col("html").alias("description"),
        F.lit("2024-01-30T10:00:00Z").alias("published_at"),
    )
    sources = spark.createDataFrame([("example.com", "com", "A"), ("example.net", "net", "B")], "domain string, name string, tier string")
    return ingest.normalise(raw, now(), sources).drop("published_at")


@query(f"""WITH {ARTICLES_SQL}, r AS (SELECT ord, unnest(list_filter([
 CASE WHEN category = 'general' AND len(entities) >= 3 THEN 'general_with_entities' END, CASE WHEN content_type = 'press_release' AND tier = 'A' THEN 'release_from_tier_a' END,
 CASE WHEN category = 'world' AND country IN ('US', 'CA') THEN 'world_at_home' END], lambda x : x IS NOT NULL)) AS rule FROM articles) SELECT ord, rule FROM r""")
def classification_warnings(spark, sf_dir):
    return ingest.warnings(articles(spark, sf_dir)).select("ord", "rule")


_TERMS = f"t AS (SELECT ord, unnest(list_distinct({_TOKENS.format('title')})) AS term FROM articles)"


@query(f"WITH {ARTICLES_SQL}, {_TERMS} SELECT term, count(*) AS df, round(ln(1 + (SELECT count(*) FROM articles) / count(*)), 9) AS idf FROM t GROUP BY term")
def document_frequency(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumn("tokens", text.tokens("title"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return linking.document_frequency(rows, "tokens").crossJoin(F.broadcast(n)).select("term", "df", F.round(scores.idf(F.col("n"), F.col("df")), 9).alias("idf"))


_FEATURES = f"""f AS (SELECT ord, list_distinct({_TOKENS.format('title')}) AS tokens,
  CASE WHEN len({_TOKENS.format('title')}) > 1 THEN list_distinct(list_transform(range(1, len({_TOKENS.format('title')})), lambda i : ({_TOKENS.format('title')})[i] || ' ' || ({_TOKENS.format('title')})[i + 1])) ELSE [] END AS bigrams,
  list_distinct(list_transform(entities, lambda e : lower(e))) AS names FROM articles)"""
_PAIRS = f"""p AS (SELECT ord, 't' AS kind, unnest(tokens) AS value, 1 AS weight FROM f UNION ALL SELECT ord, 'n', unnest(names), 2 FROM f),
  s AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY kind, value) AS n FROM p) WHERE n BETWEEN 2 AND {config.POSTING_CUTOFF}),
  c AS (SELECT a.ord AS a, b.ord AS b, sum(a.weight)::BIGINT AS shared FROM s a JOIN s b ON a.kind = b.kind AND a.value = b.value AND a.ord < b.ord GROUP BY ALL HAVING sum(a.weight) >= 2)"""


def _plain_features(spark, sf_dir):
    """Features without stems, which SQL has none of."""
    rows = linking.features(articles(spark, sf_dir))
    return rows.withColumn("stems", F.array().cast("array<string>"))


@query(f"WITH {ARTICLES_SQL}, {_FEATURES}, {_PAIRS} SELECT a, b, shared FROM c")
def candidate_pairs(spark, sf_dir):
    return linking.candidates(_plain_features(spark, sf_dir))


@query(f"""WITH {ARTICLES_SQL}, {_FEATURES}, {_PAIRS}, j AS (SELECT a, b, x.tokens AS xt, y.tokens AS yt, x.bigrams AS xb, y.bigrams AS yb, x.names AS xn, y.names AS yn FROM c JOIN f x ON a = x.ord JOIN f y ON b = y.ord)
SELECT a, b, round(0.5 * (CASE WHEN len(xt) = 0 OR len(yt) = 0 THEN 0 ELSE len(list_intersect(xt, yt)) / len(list_distinct(xt || yt)) END)
 + 0.3 * (CASE WHEN len(xb) = 0 OR len(yb) = 0 THEN 0 ELSE len(list_intersect(xb, yb)) / len(list_distinct(xb || yb)) END)
 + 0.2 * (CASE WHEN len(xn) = 0 OR len(yn) = 0 THEN 0 ELSE len(list_intersect(xn, yn)) / len(list_distinct(xn || yn)) END), 6) AS headline FROM j""")
def headline_similarity(spark, sf_dir):
    rows = checkpoint(_plain_features(spark, sf_dir))
    sided = linking.with_sides(linking.candidates(rows), rows)
    return sided.select("a", "b", F.round(linking.headline_similarity("_a", "_b"), 6).alias("headline"))


@query(f"""WITH {ARTICLES_SQL}, {_FEATURES}, {_PAIRS}, {_TERMS.replace("t AS", "tt AS")}, d AS (SELECT term, count(*) AS df FROM tt GROUP BY term), n AS (SELECT count(*) AS n FROM articles),
w AS (SELECT ord, term, ln(1 + n / df) AS w, df <= greatest({config.RARE_FLOOR}, ceil(n * {config.RARE_SHARE})) AS rare FROM tt JOIN d USING (term) CROSS JOIN n), z AS (SELECT ord, sum(w) AS s FROM w GROUP BY ord),
x AS (SELECT a, b, sum(u.w) AS bw, count_if(u.rare) AS rare FROM c JOIN w u ON u.ord = a JOIN tt v ON v.ord = b AND v.term = u.term GROUP BY a, b)
SELECT c.a, c.b, round(coalesce(bw / (p.s + q.s - bw), 0), 6) AS print, round(coalesce(bw / least(p.s, q.s), 0), 6) AS contain, coalesce(rare, 0) AS rare
FROM c LEFT JOIN x USING (a, b) LEFT JOIN z p ON p.ord = c.a LEFT JOIN z q ON q.ord = c.b""")
def weighted_similarity(spark, sf_dir):
    rows = checkpoint(_plain_features(spark, sf_dir).withColumn("terms", F.col("tokens")))
    return linking.weighted(linking.candidates(rows), rows).select("a", "b", F.round("print", 6).alias("print"), F.round("contain", 6).alias("contain"), "rare")


@query()
def pair_decisions(spark, sf_dir):
    """No step carries texts, and what is candidate is known before pairs carry their rows."""
    few = articles(spark, sf_dir).select("ord", "canonical_url", "title", "entities", "published_at", "domain", "category")
    rows = stored(linking.features(ingest.dedupe(few)))
    return linking.decide(checkpoint(linking.candidates(rows).select("a", "b")), stored(linking.weighing(rows))).select("a", "b", F.round("headline", 6).alias("headline"), "conflict", "near", "link", "supports")


@query(f"""WITH RECURSIVE {ARTICLES_SQL}, {_FEATURES},
e AS (SELECT x.ord AS a, y.ord AS b FROM f x JOIN f y ON x.ord < y.ord AND len(x.tokens) > 0 AND 5 * len(list_intersect(x.tokens, y.tokens)) >= 4 * len(list_distinct(x.tokens || y.tokens))),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, reach) AS (SELECT ord, ord FROM articles UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a)
SELECT node AS ord, min(reach) AS grp FROM r GROUP BY node""")
def near_duplicate_titles(spark, sf_dir):
    """Components of titles whose words are alike to four fifths."""
    rows = checkpoint(articles(spark, sf_dir).select("ord", F.array_distinct(text.tokens("title")).alias("tokens")))
    return linking.grouped(rows, linking.alike(rows)).select("ord", "grp")


@query()
def clustered_articles(spark, sf_dir):
    members, _ = built(spark, sf_dir)
    return members.select("ord", "grp")


@query()
def top_stories(spark, sf_dir):
    """The flagship: linked, built, scored and ranked stories, the top 100."""
    _, ranked = built(spark, sf_dir)
    return surfaces.top(ranked, {}, now()).select("rank", "cluster_id", "title", "category", "country", "source_count", "independent", "score", *(f"p_{k}" for k in config.RANKING_WEIGHTS), "status")


_GROUPS = "m AS (SELECT *, CASE WHEN ord % 4 = 0 THEN ord ELSE ord - ord % 4 END AS grp FROM articles)"


def grouped(spark, sf_dir):
    """Articles in groups of four neighbours: a stand-in whose result SQL can follow."""
    return articles(spark, sf_dir).withColumn("grp", F.col("ord") - F.col("ord") % 4)


_LEAD = "CASE tier WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END, CASE WHEN description <> '' THEN 1 ELSE 0 END + CASE WHEN len(entities) > 0 THEN 1 ELSE 0 END DESC, published_at DESC, ord"


@query(f"""WITH {ARTICLES_SQL}, {_GROUPS} SELECT grp, ord, title FROM m QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {_LEAD}) = 1""")
def lead_article(spark, sf_dir):
    return ordering.top_of_each(grouped(spark, sf_dir), ["grp"], linking.lead_order(), 1).select("grp", "ord", "title")


_LEADS = f"l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {_LEAD}) = 1 AS is_lead FROM m)"


@query(f"""WITH {ARTICLES_SQL}, {_GROUPS}, {_LEADS}, v AS (SELECT grp, category, count(*) AS n, max(is_lead::INT) AS lead FROM l GROUP BY ALL)
SELECT grp, category FROM v QUALIFY row_number() OVER (PARTITION BY grp ORDER BY (category = 'general')::INT, n DESC, lead DESC, category) = 1""")
def majority_category(spark, sf_dir):
    rows = stories.build(grouped(spark, sf_dir), now())
    return rows.select("grp", "category")


@query(f"""WITH {ARTICLES_SQL}, {_GROUPS}, s AS (SELECT grp, count_if(country = 'US') AS us, count_if(country = 'CA') AS ca FROM m GROUP BY grp),
v AS (SELECT grp, country, count(*) AS n, min(ord) AS f FROM m GROUP BY ALL), b AS (SELECT grp, country FROM v QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) = 1)
SELECT grp, CASE WHEN least(us, ca) >= 2 OR (least(us, ca) > 0 AND 3 * least(us, ca) >= us + ca) THEN 'US_CA' ELSE country END AS country FROM s JOIN b USING (grp)""")
def majority_country(spark, sf_dir):
    return stories.majority_country(grouped(spark, sf_dir))


@query(f"""WITH {ARTICLES_SQL}, {_GROUPS}, {_LEADS} SELECT grp, count(*) AS n_articles, count(DISTINCT source) AS source_count,
 greatest(1, count(DISTINCT CASE WHEN content_type <> 'press_release' THEN domain END)) AS independent, any_value(title) FILTER (is_lead) AS title,
 'c' || substr(sha256('cluster:' || arg_min(canonical_url, (published_at, ord))), 1, 12) AS cluster_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
 CASE WHEN count(*) >= 3 AND epoch_us(TIMESTAMP '{NOW}' - max(published_at)) / 6e7 <= 45 THEN 'developing'
  WHEN count(*) >= 2 AND epoch_us(max(published_at) - min(published_at)) / 3.6e9 >= 2 AND epoch_us(TIMESTAMP '{NOW}' - max(published_at)) / 6e7 <= 120 THEN 'updated' END AS status FROM l GROUP BY grp""")
def cluster_summary(spark, sf_dir):
    rows = stories.build(grouped(spark, sf_dir), now())
    return rows.select("grp", "n_articles", "source_count", "independent", "title", "cluster_id", F.array_join("sources", ",").alias("sources"), "status")


@query(f"""WITH {ARTICLES_SQL}, {_GROUPS}, {_LEADS}, n AS (SELECT grp, lower(name) AS key, count(*) AS n FROM (SELECT grp, unnest(entities) AS name FROM m) GROUP BY ALL), e AS (SELECT grp, least(8, count(*)) AS ne FROM n GROUP BY grp),
s AS (SELECT grp, count_if(country = 'US') AS us, count_if(country = 'CA') AS ca FROM m GROUP BY grp), v AS (SELECT grp, country, count(*) AS n, min(ord) AS f FROM m GROUP BY ALL),
b AS (SELECT grp, country FROM v QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) = 1),
g AS (SELECT grp, epoch_us(TIMESTAMP '{NOW}' - max(published_at)) / 3.6e9 AS h, max(CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 ELSE 0.45 END)::DOUBLE AS best, count_if(tier = 'A') AS na, any_value(content_type) FILTER (is_lead) AS ct,
  any_value(title) FILTER (is_lead) AS title, any_value(description) FILTER (is_lead) AS summary, greatest(1, count(DISTINCT CASE WHEN content_type <> 'press_release' THEN domain END)) AS ind, count(*) AS na_all,
  count_if(epoch_us(TIMESTAMP '{NOW}' - published_at) / 3.6e9 <= 3) AS recent FROM l GROUP BY grp),
p AS (SELECT grp, 35 * (CASE WHEN h <= 0 THEN 1 WHEN h >= 72 THEN 0 WHEN h > 48 THEN pow(0.5, h / 8) * (1 - (h - 48) / 24) ELSE pow(0.5, h / 8) END) AS fr,
  20 * least(1.0::DOUBLE, best + least(0.15::DOUBLE, greatest(0, na - 1) * 0.05::DOUBLE)) * (CASE WHEN ct = 'press_release' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS au,
  20 * (CASE WHEN ind <= 1 THEN 0.2::DOUBLE ELSE least(1.0::DOUBLE, 0.2::DOUBLE + ln(ind::DOUBLE) / ln(12::DOUBLE) * 0.8::DOUBLE) END) AS co,
  10 * (CASE WHEN us >= 0 AND (CASE WHEN least(us, ca) >= 2 OR (least(us, ca) > 0 AND 3 * least(us, ca) >= us + ca) THEN 'US_CA' ELSE country END) IN ('US', 'CA', 'US_CA') THEN 1.0::DOUBLE WHEN country = 'GLOBAL_NA' THEN 0.65::DOUBLE ELSE 0.35::DOUBLE END) AS ge,
  10 * least(1.0::DOUBLE, (CASE WHEN length(summary) > 40 THEN 0.35::DOUBLE ELSE 0 END) + (CASE WHEN coalesce(ne, 0) >= 2 THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN length(title) BETWEEN 35 AND 140 THEN 0.1::DOUBLE ELSE 0 END)) AS pr,
  5 * (CASE WHEN na_all <= 1 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, recent / greatest(2.0::DOUBLE, na_all * 0.6::DOUBLE)) END) AS ve FROM g JOIN s USING (grp) JOIN b USING (grp) LEFT JOIN e USING (grp))
SELECT grp, floor(fr * 10 + 0.5) / 10 AS p_freshness, floor(au * 10 + 0.5) / 10 AS p_authority, floor(co * 10 + 0.5) / 10 AS p_coverage, floor(ge * 10 + 0.5) / 10 AS p_geography,
 floor(pr * 10 + 0.5) / 10 AS p_prominence, floor(ve * 10 + 0.5) / 10 AS p_velocity FROM p""")
def score_breakdown(spark, sf_dir):
    rows = stories.breakdown(stories.build(grouped(spark, sf_dir), now()), now())
    return rows.select("grp", *(f"p_{k}" for k in config.RANKING_WEIGHTS))


@query()
def homepage(spark, sf_dir):
    return surfaces.home(built(spark, sf_dir)[1])


@query()
def section_page(spark, sf_dir):
    return surfaces.section(built(spark, sf_dir)[1], "science")


@query()
def most_covered(spark, sf_dir):
    return surfaces.most_covered(built(spark, sf_dir)[1]).select("grp", "rank", "source_count")


@query(f"""WITH {ARTICLES_SQL} SELECT ord, published_at::VARCHAR AS at FROM articles ORDER BY published_at DESC, ord LIMIT 30 OFFSET 30""")
def paged_latest(spark, sf_dir):
    """The second page of the latest articles."""
    rows = ordering.page(articles(spark, sf_dir), [F.desc("published_at"), F.asc("ord")], 2, 30)
    return rows.select("ord", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(f"""WITH {ARTICLES_SQL}, s AS (SELECT ord, (CASE WHEN contains(lower(title), 'the') THEN 3 WHEN contains(lower(description || ' ' || array_to_string(entities, ' ') || ' ' || source), 'the') THEN 1 ELSE 0 END)
 + (CASE WHEN contains(lower(title), 'there') THEN 3 WHEN contains(lower(description || ' ' || array_to_string(entities, ' ') || ' ' || source), 'there') THEN 1 ELSE 0 END) AS points FROM articles)
SELECT ord AS rank, points FROM s WHERE points >= 2 ORDER BY points DESC, ord LIMIT 40""")
def search(spark, sf_dir):
    rows = articles(spark, sf_dir).select(F.col("ord").alias("rank"), "title", F.col("description").alias("summary"), "entities", F.array("source").alias("sources"))
    return surfaces.search(rows, "the there").select("rank", F.col("points").cast("long").alias("points"))


@query(f"WITH {ARTICLES_SQL} SELECT source, min(tier) AS tier, count(*) AS n_articles FROM articles GROUP BY source")
def top_sources(spark, sf_dir):
    return surfaces.sources(articles(spark, sf_dir)).select("source", "tier", "n_articles")


@query()
def related_stories(spark, sf_dir):
    return surfaces.related(built(spark, sf_dir)[1]).select("grp", "other", "shared", F.round("score", 6).alias("score"))


@query()
def earlier_coverage(spark, sf_dir):
    _, ranked = built(spark, sf_dir)
    return surfaces.earlier(ranked, ranked).select("grp", "other", "shared")


@query()
def trending_topics(spark, sf_dir):
    return topics.trending(built(spark, sf_dir)[1])


@query()
def topic_index(spark, sf_dir):
    return topics.index(built(spark, sf_dir)[1])


@query()
def hub_counts(spark, sf_dir):
    """The words of hubs are looked for where the texts are read; a story has those of its lead."""
    hubs = articles(spark, sf_dir).select(F.col("ord").alias("lead"), classify.hubs("title", "description").alias("hubs")).where(F.size("hubs") > 0)
    return topics.hub_counts(built(spark, sf_dir)[1].select("grp", "rank", "lead").join(hubs, "lead"))


@query()
def false_splits(spark, sf_dir):
    return topics.false_splits(built(spark, sf_dir)[1])


@query("""SELECT conv_id, turn, role, length(text) AS n_chars, lag(role) OVER w AS previous_role, sum(length(text)) OVER w::BIGINT AS upto_chars, count(*) OVER (PARTITION BY conv_id) - row_number() OVER w AS turns_left
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def thread_timeline(spark, sf_dir):
    return surfaces.timeline(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(f"WITH {ARTICLES_SQL} SELECT ord, id FROM articles WHERE source = 'src1'")
def source_page(spark, sf_dir):
    return surfaces.source_page(articles(spark, sf_dir), "src1").select("ord", "id")


@query(f"""WITH {ARTICLES_SQL}, best AS (SELECT category, ord FROM articles QUALIFY row_number() OVER (PARTITION BY category ORDER BY ord) <= 5)
SELECT a.ord AS grp, b.ord AS other FROM articles a JOIN best b ON a.category = b.category AND a.ord <> b.ord QUALIFY row_number() OVER (PARTITION BY a.ord ORDER BY b.ord) <= 4""")
def more_in_category(spark, sf_dir):
    """Articles as stories of one, ranked by their order."""
    return surfaces.more_in_category(articles(spark, sf_dir).select("category", F.col("ord").alias("rank"), F.col("ord").alias("grp"))).select("grp", "other")


@query()
def country_page(spark, sf_dir):
    members, ranked = built(spark, sf_dir)
    return surfaces.country_page(ranked, members, "canada")

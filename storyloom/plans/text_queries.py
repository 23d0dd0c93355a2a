"""Text, URL, page and calendar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom import config
from storyloom.functions import classify, cleaning, dates, scores, text, urls
from storyloom.plans.registry import query
from storyloom.sources import pages as page
from storyloom.sources.tables import ARTICLES_SQL, NOW, articles, table

_TITLE = "trim(regexp_extract(text, '^[^.!?\\n]+'))"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_CLEAN = "regexp_replace(lower({0}), '[''’]', '', 'g')"
_TOKENS = f"list_filter(string_split_regex({_CLEAN}, '[^a-z0-9]+'), lambda w : length(w) > 1 AND NOT list_contains({_LIST(config.STOPWORDS)}, w))"
_DIST = "list_distinct({0})"
_URL = r"'(?i)^\s*(https?)://([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?(#\S*)?\s*$'"


def _slug(value: str, longest: int = 80) -> str:
    folded = f"regexp_replace(translate(lower({value}), '{text._ACCENTED}', '{text._PLAIN}'), '[''’]', '', 'g')"
    inner = f"regexp_replace(substr(regexp_replace(regexp_replace({folded}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {longest}), '-+$', '')"
    return f"CASE WHEN {inner} = '' THEN 'story' ELSE {inner} END"


@query(f"SELECT doc_id, {_slug(_TITLE)} AS slug, substr(sha256(text), 1, 12) AS id FROM documents")
def slug_and_id(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", text.slugify(F.trim(F.regexp_extract("text", r"^[^.!?\n]+", 0))).alias("slug"), text.stable_id("text").alias("id"))


@query()
def fnv1a_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.fnv1a("c_name").alias("hash"))


@query(f"""SELECT doc_id, len({_TOKENS.format('text')}) AS n_tokens, len(list_distinct({_TOKENS.format('text')})) AS n_distinct,
 array_to_string({_TOKENS.format(_TITLE)}, ' ') AS title_tokens FROM documents""")
def significant_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("_t", text.tokens("text"))
    title = text.tokens(F.trim(F.regexp_extract("text", r"^[^.!?\n]+", 0)))
    return rows.select("doc_id", F.size("_t").cast("long").alias("n_tokens"), F.size(F.array_distinct("_t")).cast("long").alias("n_distinct"), F.array_join(title, " ").alias("title_tokens"))


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) > 1 THEN len(list_distinct(list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1]))) ELSE 0 END AS n_bigrams FROM t""")
def bigram_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("_t", text.tokens("text")).select("doc_id", F.size(text.bigrams(F.col("_t"))).cast("long").alias("n_bigrams"))


@query("""WITH c AS (SELECT doc_id, text, substr(text, 1, 200) AS cut FROM documents),
s AS (SELECT *, length(cut) - strpos(reverse(cut), ' ') AS space FROM c)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE rtrim(substr(cut, 1, CASE WHEN strpos(cut, ' ') = 0 THEN 200 WHEN space > 120 THEN space ELSE 200 END), ' ') || '…' END AS short FROM s""")
def truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate("text", 200).alias("short"))


@query()
def meta_descriptions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.meta_description("text").alias("description"))


@query()
def stems(spark, sf_dir):
    """Distinct words with both stems."""
    words = table(spark, sf_dir, "documents").select(F.explode(text.tokens("text")).alias("word")).distinct()
    return words.select("word", text.stem(F.col("word")).alias("stem"), text.title_stem(F.col("word")).alias("title_stem"))


@query(r"""WITH s AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS h FROM s),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(h, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' ') AS h FROM b),
w AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '[ \t\r\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n+', chr(10), 'g') AS h FROM e)
SELECT page_id, length(trim(regexp_replace(h, '^\n|\n$', '', 'g'), ' ')) AS n_chars, sha256(trim(regexp_replace(h, '^\n|\n$', '', 'g'), ' ')) AS digest FROM w""")
def page_text(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", text.strip_html("html").alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2(F.col("t").cast("binary"), 256).alias("digest"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<html\b[^>]*lang="([^"]*)"', 1) AS lang,
 len(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)) AS n_links, array_to_string(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1), ' ') AS links FROM pages""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page.language("html").alias("lang"), F.size(page.links("html")).cast("long").alias("n_links"), F.array_join(page.links("html"), " ").alias("links"))


@query()
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page.title("html").alias("title"))


_HOST = rf"regexp_replace(lower(regexp_extract(url, {_URL}, 2)), '^www\.', '')"
_PATH = rf"regexp_extract(url, {_URL}, 3)"
_PAIRS = rf"list_filter(string_split(substr(regexp_extract(url, {_URL}, 4), 2), '&'), lambda p : p <> '' AND NOT list_contains({_LIST(config.TRACKING_PARAMS)}, lower(split_part(p, '=', 1))))"


@query(f"""WITH u AS (SELECT page_id, {_HOST} AS host, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS place, {_PAIRS} AS pairs FROM pages),
w AS (SELECT *, CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS q FROM u)
SELECT page_id, host, CASE WHEN place = '/' AND q = '' THEN 'https://' || host || place ELSE regexp_replace('https://' || host || place || q, '/$', '') END AS canonical FROM w""")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host("url").alias("host"), urls.canonical("url").alias("canonical"))


#: What stands before the path of every so many pages; the rest keep their own.
_SITE = ("/story/a", "/top-10", "/top-100/", "/briefing", "/topic/b", "/topics", "/source/c", "/sources", "/search", "/reports/d", "/archive", "/most-covered", "/latest/", "/us", "/canada", "/science/", "/health", "/space", "/courts", "/storyline", "/", "", "")


@query(rf"""WITH a AS (SELECT CASE WHEN page_id % 23 = 20 THEN '/' ELSE ({list(_SITE)})[page_id % 23 + 1] || {_PATH} END AS p FROM pages), f AS (SELECT CASE WHEN rtrim(p, '/') = '' THEN '/' ELSE rtrim(p, '/') END AS p, split_part(p, '/', 2) AS f FROM a)
SELECT CASE WHEN p = '/' THEN 'home' WHEN f IN {urls.OWN_TEMPLATES} THEN f WHEN f IN {urls.SHARED_TEMPLATES['country']} THEN 'country' WHEN f IN {urls.SHARED_TEMPLATES['index']} THEN 'index' WHEN f IN {config.CATEGORIES} THEN 'section' WHEN f IN {tuple(config.HUBS)} THEN 'hub' ELSE 'other' END AS template, count(*) AS n FROM f GROUP BY 1""")
def path_templates(spark, sf_dir):
    """Pages moved to the parts of a site, so that every kind of page is there."""
    rows = table(spark, sf_dir, "pages")
    part = F.element_at(F.array(*map(F.lit, _SITE)), (F.col("page_id") % 23 + 1).cast("int"))
    moved = F.when(F.col("page_id") % 23 == 20, "https://x.example.com/").otherwise(F.concat(F.lit("https://x.example.com"), part, F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1)))
    return rows.groupBy(urls.template(moved).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages),
d AS (SELECT 'example.' || t AS match, t FROM (VALUES ('com'), ('org')) v(t) UNION ALL SELECT 'spam-farm.example.org', 'spam')
SELECT page_id, host, arg_max(t, length(match)) AS owner FROM h LEFT JOIN d ON host = match OR ends_with(host, '.' || match) GROUP BY page_id, host""")
def domain_suffix_join(spark, sf_dir):
    from storyloom.operators.ingest import suffix_join

    rows = table(spark, sf_dir, "pages").select("page_id", urls.host("url").alias("host"))
    owners = spark.createDataFrame([("example.com", "com"), ("example.org", "org"), ("spam-farm.example.org", "spam")], "match string, owner string")
    return suffix_join(rows, owners, "host").select("page_id", "host", "owner")


@query(r"""SELECT doc_id, length(text) > 80 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0
 AND length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > 0.9 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS shouted FROM documents""")
def shouted_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.shouted("text").alias("shouted"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[$€£]\d[\d,.]*(?: (?:million|billion))?') || regexp_extract_all(text, '\d+-year-old')
 || regexp_extract_all(text, '\d+(?:\.\d+)?(?:%| percent)') || regexp_extract_all(text, '\b\d{1,3}(?:,\d{3})+\b'))), '|') AS phrases FROM documents""")
def numeric_phrases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(text.numeric_phrases("text")), "|").alias("phrases"))


@query("""SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS escaped FROM documents""")
def xml_escaped(spark, sf_dir):
    """Digests of the escaped texts, as a feed writer emits them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.xml_escape("text").cast("binary"), 256).alias("escaped"))


@query(f"""WITH {ARTICLES_SQL} SELECT content_type, country, count(*) AS n FROM articles GROUP BY ALL""")
def content_mix(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("content_type", "country").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE::VARCHAR AS day,
 isoyear((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE) || '-W' || lpad(week((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE)::VARCHAR, 2, '0') AS week_id,
 date_trunc('week', (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE)::DATE::VARCHAR AS week_start FROM events""")
def news_calendar(spark, sf_dir):
    day = dates.news_day("ts")
    return table(spark, sf_dir, "events").select("event_id", day.cast("string").alias("day"), dates.week_id(day).alias("week_id"), dates.week_start(day).cast("string").alias("week_start"))


@query(f"""SELECT event_id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m::BIGINT || ' min ago' WHEN m < 1440 THEN floor(m / 60)::BIGINT || ' hr ago' WHEN m < 2880 THEN 'Yesterday'
 ELSE strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%b %-d') END AS ago FROM (SELECT *, floor(epoch_us(TIMESTAMP '{NOW}' - ts) / 60e6) AS m FROM events)""")
def relative_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.relative(F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp")).alias("ago"))


@query(f"""WITH h AS (SELECT ord, epoch_us(TIMESTAMP '{NOW}' - published_at) / 3.6e9 AS h FROM ({'WITH ' + ARTICLES_SQL} SELECT * FROM articles))
SELECT ord, round(CASE WHEN h <= 0 THEN 1 WHEN h >= 72 THEN 0 WHEN h > 48 THEN pow(0.5, h / 8) * (1 - (h - 48) / 24) ELSE pow(0.5, h / 8) END, 9) AS freshness FROM h""")
def freshness(spark, sf_dir):
    hours = dates.hours_between(F.col("published_at"), F.lit(NOW).cast("timestamp"))
    return articles(spark, sf_dir).select("ord", F.round(scores.freshness(hours), 9).alias("freshness"))


@query()
def title_entities(spark, sf_dir):
    return articles(spark, sf_dir).select("ord", classify.entities("title", "text").alias("entities"))


#: Sentences that many documents of the sample tables have in common stand for chrome: some as greetings, some as openers.
_KNOWN = cleaning.Chrome(("and therhean", "nicht aulich"), ("the and attion", "to oned", "licensed under", "en laleené"), cleaning.USUAL.trailing, r"^(?:that|die|la)\b[\s:]*")


def _description_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    strip = lambda v: f"regexp_replace({v}, {quoted(f'^[{cleaning.SPACES}]+|[{cleaning.SPACES}]+$')}, '', 'g')"
    run = f"[{cleaning.SPACES}]*[{cleaning.LAYOUT}][{cleaning.SPACES}]*"
    hard = rf"[{cleaning.SPACES}]*\x{{A0}}[{cleaning.SPACES}]+|[{cleaning.SPACES}]+\x{{A0}}[{cleaning.SPACES}]*"
    text = f"regexp_replace(text, {quoted(cleaning.TEMPLATE_TOKEN)}, chr(10), 'g')"
    text = f"regexp_replace(regexp_replace({text}, {quoted(run)}, chr(10), 'g'), {quoted(hard)}, chr(10), 'g')"
    text = strip(f"regexp_replace({text}, {quoted('(?i)' + _KNOWN.trailing)}, '')")
    marked = f"regexp_replace({text}, {quoted(f'([.!?…])[{cleaning.SPACES}]+')}, '\\1' || chr(10), 'g')"
    own = lambda v: strip(f"regexp_replace({v}, {quoted('(?i)' + _KNOWN.heading)}, '')")
    count = lambda kind: f"len(regexp_extract_all(p.s, '\\p{{{kind}}}'))"
    shouted = f"length(p.s) > {cleaning.SHOUTED_LENGTH} AND {count('L')} > 0 AND {count('Lu')} > {count('L')} * {cleaning.SHOUTED_SHARE}"
    echo = f"p.i <= {cleaning.ECHO_FRAGMENTS} AND length(p.s) <= {cleaning.ECHO_LENGTH} AND NOT regexp_matches(p.s, '[.!?…]') OR {own("p.s")} = ''"
    return f"""WITH f AS (SELECT doc_id, list_filter(list_transform(string_split({marked}, chr(10)), lambda s : {strip('s')}), lambda s : s <> '') AS f FROM documents),
k AS (SELECT doc_id, coalesce(regexp_matches(f[1], {quoted(_KNOWN.greeting)}), false) AS led, list_filter(list_transform(range(1, len(f) + 1), lambda i : {{'s': f[i], 'i': i}}),
 lambda p : NOT regexp_matches(p.s, {quoted(_KNOWN.all)}) AND NOT ({shouted})) AS k FROM f),
b AS (SELECT doc_id, led, CASE WHEN led THEN k[coalesce(nullif(list_position(list_transform(k, lambda p : {echo}), false), 0), len(k) + 1) :] ELSE k END AS k FROM k)
SELECT doc_id, sha256(array_to_string(list_transform(range(1, len(k) + 1), lambda i : CASE WHEN led AND i = 1 THEN {own("k[i].s")} ELSE k[i].s END), ' ')) AS cleaned FROM b"""


@query(_description_sql())
def clean_descriptions(spark, sf_dir):
    """Digests of the texts without the sentences that stand for chrome."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(cleaning.description("text", known=_KNOWN).cast("binary"), 256).alias("cleaned"))

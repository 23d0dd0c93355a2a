"""Details, dictionaries, near misses, discovery and samples over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom import config
from storyloom.checkpoints import checkpoint
from storyloom.functions import classify
from storyloom.operators import corroborate, dictionary
from storyloom.plans.registry import query
from storyloom.sources.tables import ARTICLES_SQL, articles, spread, table


#: Names in the most articles say what a story touches, not what it is about.
GENERIC = 12


def stories_of_a_moment(rows):
    """Articles of one language published within six hours: a stand-in for stories whose result SQL can follow."""
    language = F.split("canonical_url", "/")[3]
    return rows.withColumn("grp", F.concat_ws("-", language, F.floor(F.col("ord") * 7919 % 5760 / 360).cast("string")))


_MOMENTS = "m AS (SELECT * EXCLUDE (entities), regexp_extract_all(description, '[A-Z][a-z]{6,}') AS entities, split_part(canonical_url, '/', 4) || '-' || (ord * 7919 % 5760 // 360) AS grp FROM articles)"


def _details_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    stop = "[" + ", ".join(quoted(w) for w in corroborate.NO_COUNT) + "]"
    found = [f"regexp_extract_all(whole, {quoted(f'((?i:{form}))')}, 1)" for form in (corroborate.MONEY, corroborate.AGE, corroborate.PERCENT)]
    count = f"regexp_extract_all(whole, {quoted('(?:^|[^0-9A-Za-z_$.,])(' + corroborate.COUNT + ')')}, 1)"
    counts = f"list_filter({count}, lambda p : NOT regexp_matches(regexp_extract(p, '^[0-9,]+'), {quoted(corroborate.YEAR)}) AND NOT list_contains({stop}, lower(regexp_extract(p, '[A-Za-z-]+$'))))"
    return f"""WITH {ARTICLES_SQL}, {_MOMENTS},
g AS (SELECT lower(name) AS name FROM (SELECT unnest(entities) AS name FROM m) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {GENERIC}),
s AS (SELECT grp, lower(title) AS t, list_transform(entities, lambda e : lower(e)) AS shown FROM m QUALIFY row_number() OVER (PARTITION BY grp ORDER BY ord) = 1),
d AS (SELECT grp, ord, domain, source, entities, whole, lower(whole) AS low FROM (SELECT *, trim(regexp_replace(title || ' ' || description, '\\s+', ' ', 'g')) AS whole FROM m WHERE content_type <> 'press_release')),
f AS (SELECT *, {found[0]} || {found[1]} || {found[2]} || {counts} AS figures FROM d),
c AS (SELECT grp, ord, 0 AS kind, unnest(entities) AS phrase, unnest(range(len(entities))) AS pos FROM d UNION ALL SELECT grp, ord, 1, unnest(figures), unnest(range(len(figures))) FROM f),
o AS (SELECT grp, lower(phrase) AS key, arg_min(phrase, (kind, ord, pos)) AS phrase, min((kind, ord, pos)) AS place, arg_min(kind, (kind, ord, pos)) AS kind FROM c WHERE length(phrase) >= 2 GROUP BY ALL),
w AS (SELECT o.* FROM o JOIN s USING (grp) WHERE NOT contains(t, key) AND NOT (kind = 0 AND (list_contains(shown, key) OR key IN (SELECT name FROM g)))),
h AS (SELECT w.grp, w.key, any_value(w.phrase) AS phrase, any_value(w.place) AS place, d.source, min(d.ord) AS first, list(DISTINCT d.domain) AS domains FROM w JOIN d ON d.grp = w.grp AND contains(d.low, w.key) GROUP BY w.grp, w.key, d.source),
b AS (SELECT grp, key, any_value(phrase) AS phrase, any_value(place) AS place, len(list_distinct(flatten(list(domains)))) AS domains, array_to_string(list(source ORDER BY first), ',') AS sources FROM h GROUP BY grp, key)
SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY place) AS INTEGER) AS rank, phrase, CAST(domains AS INTEGER) AS domains, sources FROM b WHERE domains >= 2 QUALIFY rank <= {corroborate.MOST_DETAILS}"""


@query(_details_sql())
def corroborated_details(spark, sf_dir):
    """Long capitalised words of the texts are the names; the first member's title and names stand for the story's."""
    rows = stories_of_a_moment(articles(spark, sf_dir)).withColumn("entities", F.regexp_extract_all("description", F.lit("[A-Z][a-z]{6,}"), 0))
    leads = rows.groupBy("grp").agg(F.min_by("title", "ord").alias("title"), F.min_by("entities", "ord").alias("entities"))
    generic = rows.select(F.explode("entities").alias("name")).groupBy(F.lower("name").alias("name")).count().orderBy(F.desc("count"), "name").limit(GENERIC)
    return corroborate.details(rows, leads, generic).select("grp", "rank", "phrase", "domains", F.array_join("sources", ",").alias("sources"))


#: Places of words in the list by frequency that stand for the sections' words and their exclusions, for places, for hubs; long texts hold all of the most frequent.
SECTION_WORDS, SECTION_NOT, PLACE_WORDS, HUB_WORDS, HUB_NOT, LAST_WORD = 300, 480, 500, 540, 600, 606
SECTIONS = [c for c in config.CATEGORIES if c != "general"]
HUBS = list(config.HUBS)
PHRASES, HUB_PHRASES = 36, 66


#: Words whose pairs are counted at first.
PAIRED = 1024


def frequent_pairs(docs, counts, most, paired=PAIRED):
    """(term, _n): the pairs of neighbouring words that most documents hold. docs: doc_id, low; counts: term, _n of all words.

    No pair is in more documents than its rarer word. So only pairs of frequent words are counted; if words beyond them are
    in as many documents as the last pair found, more words are taken.
    """
    word = lambda i: F.substring_index("term", " ", i)
    pairs = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]+ [a-z0-9]+"), 0))).alias("term"))
    while True:
        words = checkpoint(counts.orderBy(F.desc("_n"), "term").limit(paired + 1))
        beyond = words.agg(F.when(F.count(F.lit(1)) > paired, F.min("_n")).otherwise(0)).first()[0]
        known = F.broadcast(words.select(F.col("term").alias("_w")))  # paired words
        both = pairs.join(known, word(1) == F.col("_w"), "left_semi").join(known, word(-1) == F.col("_w"), "left_semi")
        found = checkpoint(both.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "term").limit(most))
        least = found.agg(F.when(F.count(F.lit(1)) == most, F.min("_n")).otherwise(0)).first()[0]
        if beyond == 0 or beyond < least:
            return found
        paired *= 4


def vocabulary(spark, sf_dir):
    """(term, r, phrase): words of four letters or more and pairs of words by the number of documents that hold them."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low")))
    counts = docs.select("doc_id", F.explode(F.array_distinct(F.split("low", "[^a-z0-9]+"))).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("_n"))
    counts = checkpoint(counts)
    ones = counts.where(F.length("term") >= 4).orderBy(F.desc("_n"), "term").limit(LAST_WORD)
    ranked = None
    for top, phrase in ((ones, False), (frequent_pairs(docs, counts, HUB_PHRASES), True)):
        top = top.withColumn("r", F.row_number().over(W.orderBy(F.desc("_n"), "term")) - 1).select("term", "r", F.lit(phrase).alias("phrase"))  # most rows
        ranked = top if ranked is None else ranked.unionByName(top)
    return checkpoint(ranked)


_VOCABULARY = f"""v AS (SELECT * FROM (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS r, false AS phrase FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents) WHERE length(term) >= 4 GROUP BY term) WHERE r < {LAST_WORD}
 UNION ALL SELECT * FROM (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS r, true AS phrase FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+ [a-z0-9]+')) AS term FROM documents) GROUP BY term) WHERE r < {HUB_PHRASES})"""


def _element(names: list[str], r):
    return F.element_at(F.array(*map(F.lit, names)), (r % len(names) + 1).cast("int"))


def section_terms(words):
    part = F.when(F.col("phrase"), F.col("r") < PHRASES).otherwise(F.col("r").between(SECTION_WORDS, PLACE_WORDS - 1))
    weight = F.when(~F.col("phrase") & (F.col("r") >= SECTION_NOT), -2).otherwise(1)
    return words.where(part).select("term", _element(SECTIONS, F.col("r")).alias("category"), weight.alias("weight"))


_SECTION_TERMS = f"""x AS (SELECT term, ({SECTIONS})[r % {len(SECTIONS)} + 1] AS category, CASE WHEN NOT phrase AND r >= {SECTION_NOT} THEN -2 ELSE 1 END AS weight FROM v WHERE CASE WHEN phrase THEN r < {PHRASES} ELSE r BETWEEN {SECTION_WORDS} AND {PLACE_WORDS - 1} END)"""
#: Which of the terms t stand in which of the texts b (ord, part, low).
_HITS = """b1 AS (SELECT DISTINCT ord, part, unnest(string_split_regex(low, '[^a-z0-9]+')) AS w FROM b),
hits AS (SELECT DISTINCT ord, part, term FROM b1 JOIN (SELECT DISTINCT term FROM x WHERE NOT contains(term, ' ')) ON w = term OR w = term || 's'
 UNION SELECT ord, part, term FROM b JOIN (SELECT DISTINCT term FROM x WHERE contains(term, ' ')) ON contains(low, term) AND regexp_matches(low, '(^|[^a-z0-9])' || term || 's?([^a-z0-9]|$)'))"""


@query(f"""WITH {ARTICLES_SQL}, {_VOCABULARY}, {_SECTION_TERMS}, b AS (SELECT ord, 1 AS part, lower(title) AS low FROM articles UNION ALL SELECT ord, 0, lower(description) FROM articles), {_HITS},
k AS (SELECT ord, term, max(part) AS part FROM hits GROUP BY ALL),
sc AS (SELECT ord, category, sum(CASE WHEN weight < 0 THEN weight WHEN part = 1 THEN CASE WHEN contains(term, ' ') THEN 4 ELSE 3 END ELSE 1 END) AS score FROM k JOIN x USING (term) GROUP BY ord, category HAVING bool_or(weight > 0)),
g AS (SELECT ord, list(category ORDER BY score DESC, category) AS cs, list(score ORDER BY score DESC, category) AS ss FROM sc WHERE score > 0 GROUP BY ord),
m AS (SELECT ord, cs, ss, ss[1] AS top, len(list_filter(ss, lambda z : z = ss[1])) AS nt, regexp_matches(lower(title || ' ' || description), '(^|[^a-z0-9])({'|'.join(config.MONEY_WORDS)})([^a-z0-9]|$)') AS money FROM articles LEFT JOIN g USING (ord)),
n AS (SELECT *, coalesce(nt > 1 AND money AND top >= 2 AND list_contains(cs[1:nt], 'business'), false) AS biz FROM m), o AS (SELECT *, cs IS NULL OR top < 2 OR (nt > 1 AND NOT biz) AS vague FROM n)
SELECT ord, CASE WHEN vague THEN 'general' WHEN biz THEN 'business' ELSE cs[1] END AS category, round(CASE WHEN vague THEN 0 WHEN len(ss) = 1 THEN 1 ELSE (top - ss[2]) / top END, 6) AS confidence,
 array_to_string(CASE WHEN cs IS NULL THEN ['general'] WHEN vague THEN (['general'] || CASE WHEN nt > 1 THEN cs[1:nt] ELSE [] END)[1:3]
  ELSE ([CASE WHEN biz THEN 'business' ELSE cs[1] END] || list_filter(list_transform(list_filter(list_zip(cs, ss), lambda z : z[2] >= greatest(3, top * 0.4)), lambda z : z[1]), lambda c : c <> CASE WHEN biz THEN 'business' ELSE cs[1] END))[1:3] END, ',') AS categories FROM o""")
def category_scores(spark, sf_dir):
    """Sections by a vocabulary of the table's own words, so that every rule has something to do."""
    terms = section_terms(vocabulary(spark, sf_dir))
    rows = spread(articles(spark, sf_dir))
    out = dictionary.sections(rows, terms, classify.money(F.concat_ws(" ", "title", "description")))
    return out.select("ord", "category", F.round("confidence", 6).alias("confidence"), F.array_join("categories", ",").alias("categories"))


_PLACE = PLACE_WORDS


def place_terms(words):
    r = F.col("r") - _PLACE
    side = F.when((r < 10) | r.between(20, 24), "US").when(r < 30, "CA").otherwise("near")
    return words.where(~F.col("phrase") & F.col("r").between(_PLACE, _PLACE + 33)).select("term", side.alias("side"), (r < 20).alias("strong"))


@query(f"""WITH {ARTICLES_SQL}, {_VOCABULARY}, x AS (SELECT term, CASE WHEN r - {_PLACE} < 10 OR r - {_PLACE} BETWEEN 20 AND 24 THEN 'US' WHEN r - {_PLACE} < 30 THEN 'CA' ELSE 'near' END AS side, r - {_PLACE} < 20 AS strong FROM v WHERE NOT phrase AND r BETWEEN {_PLACE} AND {_PLACE + 33}),
b AS (SELECT ord, 0 AS part, lower(title || ' ' || description) AS low FROM articles), {_HITS},
c AS (SELECT ord, count_if(side = 'US' AND strong) AS su, count_if(side = 'US' AND NOT strong) AS wu, count_if(side = 'CA' AND strong) AS sc, count_if(side = 'CA' AND NOT strong) AS wc, count_if(side = 'near') AS near FROM hits JOIN x USING (term) GROUP BY ord),
d AS (SELECT ord, coalesce(near, 0) AS near, coalesce(su, 0) + regexp_matches(title || ' ' || description, '(^|[^A-Za-z0-9])(US|USA|U\\.S\\.A?\\.?)([^A-Za-z0-9]|$)')::INT AS su, coalesce(wu, 0) AS wu, coalesce(sc, 0) AS sc, coalesce(wc, 0) AS wc, country AS hint FROM articles LEFT JOIN c USING (ord)),
e AS (SELECT *, su + wu + CASE WHEN hint = 'US' THEN 0.5::DOUBLE ELSE 0 END AS ru, sc + wc + CASE WHEN hint = 'CA' THEN 0.5::DOUBLE ELSE 0 END AS rc FROM d),
f AS (SELECT *, CASE WHEN su > 0 THEN ru ELSE 0::DOUBLE END AS us, CASE WHEN sc > 0 THEN rc ELSE 0::DOUBLE END AS ca FROM e), g AS (SELECT *, greatest(us, ca) AS top, us >= 1 AND ca >= 1 AND abs(us - ca) <= 1 AS bal FROM f)
SELECT ord, us, ca, CASE WHEN bal THEN 'US_CA' WHEN ca > us AND ca >= 1 THEN 'CA' WHEN us > ca AND us >= 1 THEN 'US' WHEN near >= 1 THEN 'GLOBAL_NA' ELSE 'GLOBAL' END AS country,
 round(CASE WHEN bal THEN 1 - abs(us - ca) / top WHEN top >= 1 THEN abs(us - ca) / top WHEN near >= 1 THEN least(1, near / 2) WHEN ru + rc = 0 THEN 1 ELSE 0.5 END, 6) AS confidence FROM g""")
def geography(spark, sf_dir):
    """Places by a vocabulary of the table's own words; the language's country is the provider's hint."""
    named = {"US": F.concat_ws(" ", "title", "description").rlike(r"(?<![A-Za-z0-9])(US|USA|U\.S\.A?\.?)(?![A-Za-z0-9])")}
    out = dictionary.places(spread(articles(spark, sf_dir)), place_terms(vocabulary(spark, sf_dir)), named, F.col("country"))
    return out.select("ord", "us", "ca", "country", F.round("confidence", 6).alias("confidence"))


def hub_terms(words):
    part = F.when(F.col("phrase"), F.col("r") >= PHRASES).otherwise(F.col("r") >= HUB_WORDS)
    return words.where(part).select("term", _element(HUBS, F.col("r")).alias("hub"), (~F.col("phrase") & (F.col("r") >= HUB_NOT)).alias("negative"))


@query(f"""WITH {ARTICLES_SQL}, {_VOCABULARY}, x AS (SELECT term, ({HUBS})[r % {len(HUBS)} + 1] AS hub, NOT phrase AND r >= {HUB_NOT} AS negative FROM v WHERE CASE WHEN phrase THEN r >= {PHRASES} ELSE r >= {HUB_WORDS} END),
p AS (SELECT hub, negative, '[^a-z0-9]((?:' || string_agg(replace(term, ' ', '  '), '|' ORDER BY length(term) DESC, term) || ')s?)[^a-z0-9]' AS pattern FROM x GROUP BY ALL),
t AS (SELECT ord, ' ' || regexp_replace(lower(title), '([^a-z0-9])', '\\1\\1', 'g') || ' ' AS head, ' ' || regexp_replace(lower(description), '([^a-z0-9])', '\\1\\1', 'g') || ' ' AS body FROM articles),
f AS (SELECT ord, hub, negative, list_distinct(regexp_extract_all(head, pattern, 1)) AS h, list_distinct(regexp_extract_all(body, pattern, 1)) AS s FROM t CROSS JOIN p),
c AS (SELECT ord, hub, sum(CASE WHEN negative THEN 0 ELSE 2 * len(h) + len(s) END) AS plus, sum(CASE WHEN negative THEN len(list_distinct(h || s)) ELSE 0 END) AS minus FROM f GROUP BY ALL)
SELECT hub, ord, CAST(plus - 2 * minus AS BIGINT) AS score FROM c WHERE plus > 0 AND plus - 2 * minus >= {config.HUB_THRESHOLD}""")
def hub_membership(spark, sf_dir):
    """Hubs by a vocabulary of the table's own words and pairs of words, some of which count against."""
    return dictionary.hubs(spread(articles(spark, sf_dir)), hub_terms(vocabulary(spark, sf_dir)), config.HUB_THRESHOLD)


NAMES = 40


@query(f"""WITH {ARTICLES_SQL}, n AS (SELECT name, row_number() OVER (ORDER BY count(*) DESC, name) - 1 AS r FROM (SELECT unnest(entities) AS name FROM articles) GROUP BY name ORDER BY count(*) DESC, name LIMIT {2 * NAMES}),
x AS (SELECT lower(a.name) AS term, b.name, b.r FROM n a JOIN n b ON b.r = a.r % {NAMES}), b AS (SELECT ord, 0 AS part, lower(title || '. ' || description) AS low FROM articles), {_HITS},
f AS (SELECT ord, name, min(r) AS r FROM hits JOIN x USING (term) GROUP BY ALL), l AS (SELECT ord, list(name ORDER BY r, name)[1:8] AS names FROM f GROUP BY ord)
SELECT ord, coalesce(array_to_string(names, ','), '') AS entities FROM articles LEFT JOIN l USING (ord)""")
def gazetteer_entities(spark, sf_dir):
    """The most frequent names of titles as the dictionary, the next ones as aliases of the first."""
    rows = articles(spark, sf_dir)
    top = rows.select(F.explode("entities").alias("name")).groupBy("name").count().orderBy(F.desc("count"), "name").limit(2 * NAMES)
    top = checkpoint(top.withColumn("place", F.row_number().over(W.orderBy(F.desc("count"), "name")) - 1).select("name", "place"))
    names = top.where(F.col("place") < NAMES)
    aliases = top.where(F.col("place") >= NAMES).select(F.col("name").alias("alias"), (F.col("place") % NAMES).alias("place")).join(names, "place")
    return dictionary.named(rows, names, aliases).select("ord", F.array_join("entities", ",").alias("entities"))

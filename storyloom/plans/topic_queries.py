"""Topics over the words of documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom.checkpoints import checkpoint
from storyloom.operators import topics
from storyloom.plans.registry import query
from storyloom.sources.tables import table

CURATED, ALIASES, FEWEST = 3000, 40, 2


def mentions(spark, sf_dir):
    """Words of four letters or more that stand for names, once for each document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("grp"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("name")).where(F.length("name") >= 4)


def counted(spark, sf_dir):
    """(name, n): how many documents mention a name."""
    return checkpoint(mentions(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("n")))


def vocabulary(counts):
    """(curated, aliases): every third of the most frequent words is curated, some of the next are aliases of the first."""
    top = counts.orderBy(F.desc("n"), "name").limit(CURATED)
    top = checkpoint(top.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "name")) - 1).select("name", "place"))  # CURATED rows
    aliases = top.where((F.col("place") % 3 == 1) & (F.col("place") < 3 * ALIASES)).select(F.col("name").alias("alias"), (F.col("place") - 1).alias("place"))
    return top.where(F.col("place") % 3 == 0), aliases.join(top, "place").select("alias", "name")


_TOPICS = f"""m AS (SELECT DISTINCT doc_id AS grp, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS name FROM documents), mm AS (SELECT * FROM m WHERE length(name) >= 4),
top AS (SELECT name, row_number() OVER (ORDER BY count(*) DESC, name) - 1 AS place FROM mm GROUP BY name ORDER BY count(*) DESC, name LIMIT {CURATED}),
cur AS (SELECT name, place FROM top WHERE place % 3 = 0), ali AS (SELECT a.name AS alias, b.name FROM top a JOIN top b ON b.place = a.place - 1 WHERE a.place % 3 = 1 AND a.place < {3 * ALIASES}),
vs AS (SELECT name AS key, place, unnest(list_filter([name || 's', CASE WHEN regexp_matches(name, '[^aeiou]y$') THEN left(name, -1) || 'ies' END, CASE WHEN regexp_matches(name, '(s|x|z|ch|sh)$') THEN name || 'es' END,
 CASE WHEN length(name) > 4 AND name LIKE '%ies' THEN left(name, -3) || 'y' END, CASE WHEN length(name) > 4 AND regexp_matches(name, '(ses|xes|zes|ches|shes)$') THEN left(name, -2) END,
 CASE WHEN length(name) > 3 AND regexp_matches(name, '[^s]s$') THEN left(name, -1) END], lambda v : v IS NOT NULL AND length(v) > 2)) AS name FROM cur),
ck AS (SELECT name, name AS key FROM cur UNION ALL SELECT name, arg_min(key, (place, key)) FROM vs WHERE name NOT IN (SELECT name FROM cur) GROUP BY name),
k AS (SELECT mm.grp, mm.name, coalesce(ali.name, mm.name) AS display FROM mm LEFT JOIN ali ON ali.alias = mm.name),
kk AS (SELECT k.*, left(coalesce(ck.key, display), 60) AS key, display IN (SELECT name FROM cur) AS curated FROM k LEFT JOIN ck ON ck.name = display)"""


@query(f"WITH {_TOPICS} SELECT DISTINCT name, display, key, curated FROM kk")
def topic_keys(spark, sf_dir):
    counts = counted(spark, sf_dir)
    return topics.with_keys(counts, *vocabulary(counts)).select("name", "display", "key", "curated")


_DIRECTORY = f"""f AS (SELECT key, display, count(*) AS n FROM kk GROUP BY ALL),
d AS (SELECT key, arg_min(display, (-n, display)) AS display, list(left(display, 60)) AS slugs FROM f GROUP BY key), s AS (SELECT key, count(DISTINCT grp) AS n_stories, bool_or(curated) AS curated FROM kk GROUP BY key),
dir AS (SELECT key, left(display, 60) AS slug, display, n_stories, curated, curated OR n_stories >= {FEWEST} AS eligible, list_sort(list_distinct(slugs || [key, left(display, 60)])) AS variants FROM d JOIN s USING (key))"""


@query(f"WITH {_TOPICS}, {_DIRECTORY} SELECT key, slug, display, n_stories, curated, eligible, array_to_string(variants, ',') AS variants FROM dir")
def topic_directory(spark, sf_dir):
    counts = counted(spark, sf_dir)
    names = checkpoint(topics.with_keys(counts, *vocabulary(counts)))
    return topics.directory_of_names(names, mentions(spark, sf_dir), FEWEST).withColumn("variants", F.array_join("variants", ","))


@query(f"""WITH {_TOPICS}, {_DIRECTORY}, r AS (SELECT DISTINCT name AS slug FROM ck UNION SELECT DISTINCT left(name, 60) FROM mm), v AS (SELECT unnest(variants) AS slug, key, n_stories FROM dir), own AS (SELECT slug, arg_max(key, (n_stories, key)) AS key FROM v GROUP BY slug),
i AS (SELECT r.slug, left(coalesce(ck.key, coalesce(ali.name, r.slug)), 60) AS key FROM r LEFT JOIN ali ON ali.alias = r.slug LEFT JOIN ck ON ck.name = coalesce(ali.name, r.slug))
SELECT slug, coalesce(own.key, dir.key) AS key, CASE WHEN own.key IS NOT NULL THEN 'variant' ELSE 'identity' END AS by FROM i LEFT JOIN own USING (slug) LEFT JOIN dir ON dir.key = i.key WHERE coalesce(own.key, dir.key) IS NOT NULL""")
def topic_resolution(spark, sf_dir):
    """Every name and every spelling that the curated names license, as requested slugs."""
    counts = counted(spark, sf_dir)
    curated, aliases = vocabulary(counts)
    names = checkpoint(topics.with_keys(counts, curated, aliases))
    known = checkpoint(topics.directory_of_names(names, mentions(spark, sf_dir), FEWEST))
    slugs = topics.curated_keys(curated).select(F.col("name").alias("slug")).unionByName(counts.select(F.substring("name", 1, 60).alias("slug"))).distinct()
    return topics.resolved(slugs, known, curated, aliases)


@query(f"WITH {_TOPICS}, b AS (SELECT key FROM kk GROUP BY key HAVING count(DISTINCT display) > 1 ORDER BY count(DISTINCT grp) DESC, key LIMIT 1) SELECT DISTINCT key, grp FROM kk WHERE key IN (SELECT key FROM b)")
def topic_stories(spark, sf_dir):
    """Documents of the most covered topic that has several spellings."""
    counts = counted(spark, sf_dir)
    names = checkpoint(topics.with_keys(counts, *vocabulary(counts)))
    rows = checkpoint(topics.several_spellings(names, mentions(spark, sf_dir)))
    forms = names.groupBy("key").agg(F.count_distinct("display").alias("_forms")).where("_forms > 1")
    best = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).join(forms, "key").orderBy(F.desc("_n"), "key").limit(1)
    return rows.join(F.broadcast(best.select("key")), "key", "left_semi")

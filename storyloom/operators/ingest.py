"""From provider rows to articles: validation, identity, limits, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom import config
from storyloom.functions import classify, dates, text, urls


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; ordinary dropDuplicates would keep any."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def normalise(raw: DataFrame, now: Column, sources: DataFrame | None = None) -> DataFrame:
    """Articles of raw (ord, title, url, source, description, published_at as text): rows that fail a check go.

    sources: slug, name, domain, tier; a row finds its source by the longest suffix of its host, else by name.
    """
    rows = raw.select(
        "*",
        urls.canonical("url").alias("canonical_url"),
        urls.host("url").alias("domain"),
        dates.instant("published_at").alias("at"),
    )
    title = F.trim(F.regexp_replace(text.strip_html("title"), "\n", " "))
    rows = rows.where((F.length(F.trim("title")) >= 8) & (F.lower(F.trim("title")) != "[removed]") & F.col("canonical_url").isNotNull() & F.col("at").isNotNull() & (F.trim("source") != ""))
    rows = rows.where(F.col("at") <= now + F.make_dt_interval(mins=F.lit(config.FUTURE_MINUTES)))
    clean = F.substring(text.strip_html("description"), 1, 500)
    out = rows.select(
        "ord",
        text.stable_id("canonical_url").alias("id"),
        "canonical_url",
        "domain",
        F.trim("source").alias("source"),
        F.substring(title, 1, 300).alias("title"),
        F.when(clean != "", clean).alias("description"),
        F.col("at").alias("published_at"),
    )
    out = out.withColumn("content_type", classify.content_type("title", "description", "domain"))
    found = classify.category(classify.category_scores("title", "description"), classify.money(F.concat_ws(" ", "title", "description")))
    out = out.withColumn("_c", found).withColumn("country", classify.country("title", "description")["country"])
    section = demote(F.col("_c.category"), F.col("_c.categories"), F.col("country"), F.col("_c.confidence"))
    out = out.select("*", section.alias("category"), text.slugify("title").alias("_slug"), classify.entities("title", "description").alias("entities"))
    out = out.withColumn("slug", F.concat_ws("-", "_slug", "id")).drop("_c", "_slug")
    return out if sources is None else with_tier(out, sources)


def demote(category: Column, categories: Column, country: Column, confidence: Column) -> Column:
    """A domestic story that is only weakly world news takes its next section."""
    following = F.get(F.filter(categories, lambda c: c != "world"), 0)
    return F.when((category == "world") & country.isin("US", "CA") & (confidence < 0.5), F.coalesce(following, F.lit("general"))).otherwise(category)


def suffix_join(rows: DataFrame, domains: DataFrame, key: str = "domain") -> DataFrame:
    """rows with the columns of domains (match and others) at the longest suffix of their host."""
    parts = rows.select(key).distinct().select(key, F.posexplode(urls.suffixes(F.col(key))).alias("_depth", "match"))
    hit = parts.join(domains, "match")
    best = first_wins(hit, [key], ["_depth"]).drop("_depth")
    return rows.join(best, key, "left")


def with_tier(articles: DataFrame, sources: DataFrame) -> DataFrame:
    by_domain = suffix_join(articles, sources.select(F.col("domain").alias("match"), F.col("tier").alias("_by_domain"))).drop("match")
    by_name = sources.select(F.lower(F.trim("name")).alias("_name"), F.col("tier").alias("_by_name")).dropDuplicates(["_name"])
    out = by_domain.join(by_name, F.lower(F.trim(by_domain["source"])) == F.col("_name"), "left")
    return out.withColumn("tier", F.coalesce("_by_domain", "_by_name", F.lit("C"))).drop("_by_domain", "_by_name", "_name")


def within_age(articles: DataFrame, now: Column, hours: int = config.MAX_AGE_HOURS) -> DataFrame:
    return articles.where(F.col("published_at") >= now - F.make_dt_interval(hours=F.lit(hours)))


def newest(articles: DataFrame, most: int = config.ARTICLE_CAP) -> DataFrame:
    """All rows whose id is among the newest; copies of such an id stay for the dedupe that follows."""
    ids = articles.orderBy(F.desc("published_at"), "ord").limit(most).select("id").distinct()
    return articles.join(ids, "id", "left_semi")


def dedupe(articles: DataFrame) -> DataFrame:
    return first_wins(articles, ["canonical_url"], ["ord"])


def age_metrics(articles: DataFrame, now: Column) -> DataFrame:
    """Counts and nearest-rank percentiles of age in hours."""
    hours = dates.hours_between(F.col("published_at"), now)
    return articles.select(hours.alias("h")).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.expr(f"round(percentile_disc({q}) WITHIN GROUP (ORDER BY h), 4)").alias(f"p{int(q * 100)}") for q in (0.5, 0.9)),
    )


def coherent_labels(articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Members take the section and place of their cluster."""
    labels = clusters.select("cluster_id", F.col("category").alias("_category"), F.col("country").alias("_country"))
    out = articles.join(labels, "cluster_id", "left")
    return out.withColumn("category", F.coalesce("_category", "category")).withColumn("country", F.coalesce("_country", "country")).drop("_category", "_country")


def warnings(articles: DataFrame) -> DataFrame:
    """Rows that a reader should look at: general with entities, releases from ranked sources, foreign business."""
    rules = [
        ("general_with_entities", (F.col("category") == "general") & (F.size("entities") >= 3)),
        ("release_from_tier_a", (F.col("content_type") == "press_release") & (F.col("tier") == "A")),
        ("world_at_home", (F.col("category") == "world") & F.col("country").isin("US", "CA")),
    ]
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules)), lambda r: r.isNotNull())
    return articles.select("id", "ord", "title", F.explode(found).alias("rule"))

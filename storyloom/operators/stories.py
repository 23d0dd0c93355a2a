"""Stories from grouped articles: identity, lead, labels, counts, status, score, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom import config
from storyloom.functions import dates, scores, text
from storyloom.operators.linking import lead_order
from storyloom.operators.ordering import with_place


def majority_category(members: DataFrame) -> DataFrame:
    """(grp, category): most votes without general unless all are; the lead's on a tie, else the first by name."""
    votes = members.groupBy("grp", "category").agg(F.count(F.lit(1)).alias("votes"), F.max(F.col("is_lead").cast("int")).alias("lead"))
    order = W.partitionBy("grp").orderBy((F.col("category") == "general").asc(), F.desc("votes"), F.desc("lead"), F.asc("category"))
    return votes.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("grp", "category")


def majority_country(members: DataFrame) -> DataFrame:
    """(grp, country): both countries where the smaller has two votes or a third of them, else the most frequent."""
    sums = members.groupBy("grp").agg(
        F.count_if(F.col("country") == "US").alias("us"),
        F.count_if(F.col("country") == "CA").alias("ca"),
    )
    votes = members.groupBy("grp", "country").agg(F.count(F.lit(1)).alias("votes"), F.min("ord").alias("first"))
    best = votes.withColumn("_n", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("votes"), "first"))).where("_n = 1").select("grp", F.col("country").alias("_most"))
    least = F.least("us", "ca")
    shared = (least >= 2) | ((least > 0) & (3 * least >= F.col("us") + F.col("ca")))
    return sums.join(best, "grp").select("grp", F.when(shared, F.lit("US_CA")).otherwise(F.col("_most")).alias("country"))


def build(members: DataFrame, now: Column) -> DataFrame:
    """One row per story. members: articles with grp."""
    lead = W.partitionBy("grp").orderBy(*lead_order())
    rows = members.withColumn("is_lead", F.row_number().over(lead) == 1)
    editorial = F.when(F.col("content_type") != "press_release", F.col("domain"))
    head = lambda c: F.max(F.when(F.col("is_lead"), F.col(c)))
    hours = dates.hours_between(F.col("published_at"), now)
    base = rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.count_distinct("source").alias("source_count"),
        F.greatest(F.lit(1), F.count_distinct(editorial)).alias("independent"),
        F.min("published_at").alias("first_at"),
        F.max("published_at").alias("last_at"),
        head("ord").alias("lead"),
        head("title").alias("title"),
        head("description").alias("summary"),
        head("content_type").alias("content_type"),
        F.min_by("canonical_url", F.struct("published_at", "ord")).alias("earliest_url"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.max(scores.tier_weight(F.col("tier"))).alias("best_tier"),
        F.count_if(F.col("tier") == "A").alias("top_tier"),
        F.count_if(hours <= 3).alias("recent"),
        F.bool_and(F.col("content_type") == "press_release").alias("all_release"),
    )
    names = rows.select("grp", F.explode("entities").alias("name")).groupBy("grp", F.lower("name").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    tops = names.withColumn("_n", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("n"), "key"))).where("_n <= 8")
    entities = tops.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "name"))), lambda s: s["name"]).alias("entities"))
    out = base.join(majority_category(rows), "grp").join(majority_country(rows), "grp").join(entities, "grp", "left")
    out = out.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    out = out.withColumn("cluster_id", F.concat(F.lit("c"), text.stable_id(F.concat(F.lit("cluster:"), "earliest_url"))))
    age = dates.hours_between(F.col("last_at"), now) * 60
    span = dates.hours_between(F.col("first_at"), F.col("last_at"))
    status = F.when((F.col("n_articles") >= 3) & (age <= 45), "developing").when((F.col("n_articles") >= 2) & (span >= 2) & (age <= 120), "updated")
    return out.withColumn("status", status)


def breakdown(stories: DataFrame, now: Column) -> DataFrame:
    """Stories with the six parts of their score and its total, which is rounded from unrounded parts."""
    w = config.RANKING_WEIGHTS
    parts = {
        "freshness": scores.freshness(dates.hours_between(F.col("last_at"), now)),
        "authority": scores.authority(F.col("best_tier"), F.col("top_tier"), F.col("content_type") == "press_release"),
        "coverage": scores.coverage(F.col("independent")),
        "geography": scores.geography(F.col("country")),
        "prominence": scores.prominence(F.lit(None).cast("string"), F.col("summary"), F.size("entities"), F.col("title")),
        "velocity": scores.velocity(F.col("recent"), F.col("n_articles")),
    }
    total = sum((parts[k] * w[k] for k in parts), F.lit(0.0))
    return stories.select("*", *(scores.rounded(parts[k] * w[k]).alias(f"p_{k}") for k in parts), scores.rounded(total).alias("score"))


def breaking(now: Column) -> Column:
    age = dates.hours_between(F.col("last_at"), now) * 60
    enough = (F.col("independent") >= 4) | ((F.col("independent") >= 3) & (F.col("top_tier") > 0))
    return ~F.col("content_type").isin("press_release", "opinion") & (F.col("score") >= 85) & (age <= 90) & enough


def ranked(stories: DataFrame, now: Column, most: int | None = None) -> DataFrame:
    """Scored stories with their rank; only the first may be breaking, and is live then. most: a top-k report."""
    scored = breakdown(stories, now)
    order = [F.desc("score"), F.asc("grp")]
    place = with_place(scored.orderBy(*order).limit(most) if most else scored, order, "rank")
    return place.withColumn("status", F.when((F.col("rank") == 1) & breaking(now), "live").otherwise(F.col("status")))


def eligible() -> Column:
    """Curated surfaces leave out stories that are only press releases."""
    return ~F.col("all_release")

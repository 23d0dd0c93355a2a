"""Readers of stored tables, and the article view over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom import config
from storyloom.functions import text

#: The moment at which every query over the sample tables runs.
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """frame over all cores where it comes from fewer splits, as from one small file; tables of many splits stay as they are."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first sentence is the title, the whole text the description; time and section follow from doc_id."""
    docs = table(spark, sf_dir, "documents")
    title = F.trim(F.regexp_extract("text", r"^[^.!?\n]+", 0))
    section = F.element_at(F.array(*map(F.lit, config.CATEGORIES)), (F.length("text") % len(config.CATEGORIES) + 1).cast("int"))
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12))
    minutes = F.col("doc_id") * 7919 % 5760
    country = F.when(F.col("lang") == "en", F.when(F.col("doc_id") % 3 == 0, "CA").otherwise("US")).when(F.col("lang") == "fr", "US_CA").when(F.col("lang") == "es", "GLOBAL_NA").otherwise("GLOBAL")
    return docs.select(
        F.col("doc_id").alias("ord"),
        text.stable_id(url).alias("id"),
        url.alias("canonical_url"),
        title.alias("title"),
        F.col("text").alias("description"),
        "text",
        "source",
        F.concat("source", F.lit(".example.com")).alias("domain"),
        F.when(F.substring("source", 4, 9).cast("int") % 3 == 0, "A").when(F.substring("source", 4, 9).cast("int") % 3 == 1, "B").otherwise("C").alias("tier"),
        country.alias("country"),
        section.alias("category"),
        F.when(F.col("doc_id") % 11 == 0, "press_release").when(F.col("doc_id") % 13 == 0, "opinion").otherwise("news").alias("content_type"),
        F.array_distinct(F.regexp_extract_all(title, F.lit("[A-Z][a-z]{4,}"), 0)).alias("entities"),
        (F.lit(NOW).cast("timestamp") - F.make_dt_interval(mins=minutes.cast("int"))).alias("published_at"),
    )


#: DuckDB's form of articles().
ARTICLES_SQL = f"""articles AS (
  SELECT ord, substr(sha256(canonical_url), 1, 12) AS id, * EXCLUDE (ord), list_distinct(regexp_extract_all(title, '[A-Z][a-z]{{4,}}')) AS entities FROM (
  SELECT doc_id AS ord, 'https://' || source || '.example.com/' || lang || '/' || substr(sha256(text), 1, 12) AS canonical_url,
    trim(regexp_extract(text, '^[^.!?\\n]+')) AS title, text AS description, text, source, source || '.example.com' AS domain,
    CASE substr(source, 4)::INT % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS tier,
    CASE WHEN lang = 'en' THEN CASE WHEN doc_id % 3 = 0 THEN 'CA' ELSE 'US' END WHEN lang = 'fr' THEN 'US_CA' WHEN lang = 'es' THEN 'GLOBAL_NA' ELSE 'GLOBAL' END AS country,
    ({list(config.CATEGORIES)})[length(text) % {len(config.CATEGORIES)} + 1] AS category,
    CASE WHEN doc_id % 11 = 0 THEN 'press_release' WHEN doc_id % 13 = 0 THEN 'opinion' ELSE 'news' END AS content_type,
    TIMESTAMP '{NOW}' - to_minutes(doc_id * 7919 % 5760) AS published_at FROM documents))"""

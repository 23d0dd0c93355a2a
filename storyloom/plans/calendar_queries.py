"""Weeks and the weekly report, over orders as stories and line items as what happened to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import dates
from storyloom.operators import reports
from storyloom.plans.registry import query
from storyloom.sources.tables import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: What weeks and news days are reckoned from in these queries.
TODAY = "2024-06-12 03:00:00"
FIRST = "2003-W10"

_IDS = "SELECT o_orderkey, (2000 + o_orderkey % 40)::VARCHAR || '-W' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS id, 2000 + o_orderkey % 40 AS y, o_orderkey % 60 AS w FROM orders"
_LABEL = """CASE WHEN year(m) <> year(m + 6) THEN strftime(m, '%b %-d, %Y') ELSE strftime(m, '%b %-d') END || '–' ||
 CASE WHEN year(m) = year(m + 6) AND month(m) = month(m + 6) THEN strftime(m + 6, '%-d, %Y') ELSE strftime(m + 6, '%b %-d, %Y') END"""


def _ids(spark, sf_dir):
    year, week = 2000 + F.col("o_orderkey") % 40, F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(year.cast("string"), F.lit("-W"), week).alias("id"))


@query(f"""WITH i AS ({_IDS}), p AS (SELECT *, CASE WHEN w BETWEEN 1 AND strftime(make_date(y, 12, 28), '%V')::INT THEN (date_trunc('week', make_date(y, 1, 4))::DATE + (w::INT - 1) * 7) END AS m FROM i)
SELECT o_orderkey, id, m::VARCHAR AS monday, (m + 6)::VARCHAR AS sunday, {_LABEL} AS label,
 (m::TIMESTAMP AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC')::VARCHAR AS opens, strftime(m - 7, '%G-W%V') AS previous, strftime(m + 7, '%G-W%V') AS following,
 m IS NOT NULL AND id >= '{FIRST}' AND id < strftime((TIMESTAMP '{TODAY}' AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE, '%G-W%V') AS reportable FROM p""")
def week_ranges(spark, sf_dir):
    monday = dates.parse_week("id")
    return _ids(spark, sf_dir).select(
        "o_orderkey",
        "id",
        monday.cast("string").alias("monday"),
        F.date_add(monday, 6).cast("string").alias("sunday"),
        dates.week_label(monday).alias("label"),
        F.date_format(dates.midnight(monday), "yyyy-MM-dd HH:mm:ss").alias("opens"),
        dates.shifted_week("id", -1).alias("previous"),
        dates.shifted_week("id", 1).alias("following"),
        dates.reportable_week(F.col("id"), F.lit(TODAY).cast("timestamp"), FIRST).alias("reportable"),
    )


_WEEK = "strftime((o_orderdate AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE, '%G-W%V')"
_STORIES = f"s AS (SELECT o_orderkey, {_WEEK} AS week, o_orderdate, o_totalprice, o_orderpriority, coalesce(n, 0) AS ever FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) USING (o_orderkey))"
_PCT = lambda test: f"CASE WHEN count(*) = 0 THEN 0 ELSE floor(1000.0 * count_if({test}) / count(*) + 0.5) / 10 END"


def _stories(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_suppkey").alias("n"))
    orders = table(spark, sf_dir, "orders").withColumn("week", dates.week_id(dates.news_day("o_orderdate")))
    return orders.join(n, "o_orderkey", "left").withColumn("ever", F.coalesce("n", F.lit(0)))


@query(f"""WITH {_STORIES} SELECT week, {_PCT("ever <= 1")} AS single_pct, {_PCT("ever = 2")} AS two_pct, {_PCT("ever >= 3")} AS three_up_pct, {_PCT("ever >= 4")} AS four_up_pct,
 {_PCT("ever >= 2")} AS multi_pct, median(ever) AS median, floor(avg(ever) * 10 + 0.5) / 10 AS mean FROM s GROUP BY week""")
def week_concentration(spark, sf_dir):
    return reports.concentration(_stories(spark, sf_dir), "week", "ever")


@query(f"""WITH {_STORIES}, c AS (SELECT week, o_orderpriority AS label, count(*) AS n FROM s GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY week ORDER BY n DESC, list_position({PRIORITIES}, label)) = 1""")
def week_top_category(spark, sf_dir):
    return reports.top_label(_stories(spark, sf_dir), "week", "o_orderpriority", PRIORITIES)


@query(f"""WITH {_STORIES} SELECT week, o_orderkey, ever, row_number() OVER (PARTITION BY week ORDER BY ever DESC, o_totalprice DESC, o_orderdate, o_orderkey) AS place FROM s QUALIFY place <= 5""")
def week_most_covered(spark, sf_dir):
    """The five most covered stories of each week: the limit is the report's."""
    return reports.most_covered(_stories(spark, sf_dir), "week", "ever", "o_totalprice", "o_orderdate", "o_orderkey", 5).select("week", "o_orderkey", "ever", "place")


_CHANGES = "c AS (SELECT l_orderkey, o_orderdate AS seen, l_shipdate AS t, l_linenumber - 1 AS source, l_linenumber + (l_suppkey % 3)::INT AS too FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _changes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("seen"))
    to = F.col("l_linenumber") + (F.col("l_suppkey") % 3).cast("int")
    return table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select("l_orderkey", "seen", F.col("l_shipdate").alias("at"), (F.col("l_linenumber") - 1).alias("source"), to.alias("too"))


@query(f"""WITH {_CHANGES}, g AS (SELECT l_orderkey, min(seen) AS seen, arg_min(source, (t, source)) AS source, min(t) FILTER (too >= 3) AS reached FROM c GROUP BY 1)
SELECT l_orderkey, greatest(0, floor(epoch_us(reached) / 6e7 - epoch_us(seen) / 6e7 + 0.5))::BIGINT AS minutes FROM g WHERE source < 3 AND reached IS NOT NULL""")
def minutes_to_three(spark, sf_dir):
    return reports.reach(_changes(spark, sf_dir), "l_orderkey", "seen", "at", "source", "too", 3)


@query(f"""WITH {_CHANGES}, g AS (SELECT l_orderkey, min(seen) AS seen, arg_min(source, (t, source)) AS source, max(too) FILTER (t <= seen + INTERVAL 720 HOUR) AS too,
  arg_min(t, (-too, t)) FILTER (t <= seen + INTERVAL 720 HOUR) AS best FROM c GROUP BY 1)
SELECT l_orderkey, source, too AS "to", too - source AS gained, greatest(0, floor(epoch_us(best) / 6e7 - epoch_us(seen) / 6e7 + 0.5))::BIGINT AS minutes FROM g WHERE too > source""")
def biggest_pickups(spark, sf_dir):
    return reports.pickup_gain(_changes(spark, sf_dir), "l_orderkey", "seen", "at", "source", "too", hours=720)


@query("""SELECT o_orderkey, CASE WHEN k IS NULL OR k = 'news' THEN 'news' WHEN k IN ('opinion', 'press_release') THEN k ELSE 'other' END AS bucket
FROM (SELECT o_orderkey, [NULL, 'news', 'opinion', 'press_release', 'live'][o_orderkey % 5 + 1] AS k FROM orders)""")
def content_buckets(spark, sf_dir):
    kinds = F.array(F.lit(None), *map(F.lit, ("news", "opinion", "press_release", "live")))
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.content_bucket(F.get(kinds, (F.col("o_orderkey") % 5).cast("int"))).alias("bucket"))

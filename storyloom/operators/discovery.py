"""When stories are first seen in search, by how many publications they have, and what each story earns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EARLY_DAYS, YOUNGEST_HOURS, SIGNALS_CAP = 28, 72, 20_000


def asof(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str], stretch: str = "day") -> DataFrame:
    """left with the right side's columns and time (as right_<name>) of the last row at or before it, by key; null where there is none.

    Both sides are one table in order of time; the last value before a row is a window's.  The windows are of a key and a stretch of
    time, so a key with much of the table is many windows; what earlier stretches end with is one row each, which a
    second window hands on.  No row is multiplied.  Right rows of one key and time: the greatest by their columns counts.
    """
    value = F.struct(time, *columns)
    both = left.withColumn("_value", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)).withColumn("_left", F.lit(True))
    both = both.unionByName(right.select(key, time, value.alias("_value"), F.lit(False).alias("_left")), allowMissingColumns=True)
    both = both.withColumn("_part", F.date_trunc(stretch, time))
    order = W.partitionBy(key, "_part").orderBy(time, F.col("_left"), "_value")  # right rows of the same time come first
    near = both.withColumn("_last", F.last("_value", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    ends = right.groupBy(key, F.date_trunc(stretch, time).alias("_part")).agg(F.max(value).alias("_end"))
    parts = both.select(key, "_part").distinct().join(ends, [key, "_part"], "left")
    carried = parts.withColumn("_before", F.last("_end", ignorenulls=True).over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).select(key, "_part", "_before")
    found = near.where("_left").join(carried, [key, "_part"], "left").withColumn("_v", F.coalesce("_last", "_before"))
    return found.select(*left.columns, F.col(f"_v.{time}").alias(f"right_{time}"), *(F.col(f"_v.{c}").alias(f"right_{c}") for c in columns))


def early_discovery(ledger: DataFrame, days: DataFrame, now: Column, window: int = EARLY_DAYS, youngest: int = YOUNGEST_HOURS) -> DataFrame:
    """One row over stories (id, published_at) old enough to have been found: how many were, within how many hours, and the median.

    days: (id, day, impressions).  Hours run to the end of the first day with an impression, the latest that it can have been.
    Percentages are of all eligible stories, null without any.
    """
    first = days.where("impressions > 0").groupBy("id").agg(F.min("day").alias("day"))
    old = (F.col("published_at") >= now - F.make_dt_interval(days=F.lit(window))) & (F.col("published_at") <= now - F.make_dt_interval(hours=F.lit(youngest)))
    end = F.unix_micros((F.to_date("day") + 1).cast("timestamp"))
    hours = F.greatest(F.lit(0.0), (end - F.unix_micros(F.col("published_at").cast("timestamp"))) / 3_600_000_000)
    rows = ledger.where(old).join(first, "id", "left").withColumn("hours", hours)
    n = F.count(F.lit(1))
    pct = lambda test: F.when(n > 0, F.floor(F.count_if(test) / n * 1000 + 0.5) / 10)
    return rows.agg(
        n.alias("eligible"),
        F.count("hours").alias("discovered"),
        pct(F.col("hours").isNotNull()).alias("discovered_pct"),
        *(pct(F.col("hours") <= h).alias(f"within_{h}h_pct") for h in (24, 48, 72)),
        F.floor(F.median("hours") + 0.5).cast("long").alias("median_hours"),
    )


def publications(live: DataFrame, archive: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, publications): the most that any of the three has heard of; ids that none knows are not there.

    live and ledger: (id, n); archive: (id, source_count, union_publications, peak_history), whose numbers may be null.
    """
    stored = archive.select("id", F.greatest(*(F.coalesce(c, F.lit(0)) for c in ("source_count", "union_publications", "peak_history"))).alias("n"))
    every = live.select("id", F.col("n").cast("long")).unionByName(stored.select("id", F.col("n").cast("long"))).unionByName(ledger.select("id", F.col("n").cast("long")))
    return every.groupBy("id").agg(F.max(F.coalesce("n", F.lit(0))).alias("publications"))


def bucket_keys(n: Column) -> Column:
    """The exact bucket of a number of publications and the cumulative ones; null is unknown."""
    exact = F.when(n.isNull(), "unknown").when(n <= 1, "1").when(n <= 3, n.cast("string")).otherwise("4+")
    more = [F.when(n >= k, F.lit(f"{k}+")) for k in (2, 3)]
    return F.filter(F.array(exact, *more), lambda k: k.isNotNull())


def by_publications(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(bucket, urls, impressions, clicks, ctr, position) of page rows (url, id, impressions, clicks, position) by publications().

    Buckets overlap on purpose; a row without a story id is in none.  The position is weighed by impressions.
    """
    found = rows.where(F.col("id").isNotNull()).join(known, "id", "left").withColumn("bucket", F.explode(bucket_keys(F.col("publications"))))
    sums = found.groupBy("bucket").agg(F.count_distinct("url").alias("urls"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum(F.col("position") * F.col("impressions")).alias("_p"))
    rate = lambda x: F.when(F.col("impressions") > 0, F.round(x / F.col("impressions"), 6))
    return sums.select("bucket", "urls", "impressions", "clicks", rate(F.col("clicks")).alias("ctr"), rate(F.col("_p")).alias("position"))


def story_signals(rows: DataFrame, least: int = 1, cap: int = SIGNALS_CAP) -> DataFrame:
    """(id, impressions, clicks, rank) of stories with enough impressions over all surfaces, the most first; a report of cap rows."""
    sums = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.sum(F.coalesce("impressions", F.lit(0))).alias("impressions"), F.sum(F.coalesce("clicks", F.lit(0))).alias("clicks"))
    best = sums.where(F.col("impressions") >= least).orderBy(F.desc("impressions"), F.desc("clicks"), "id").limit(cap)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("impressions"), F.desc("clicks"), "id")))


def protected(signals: DataFrame, stories: DataFrame, least: int) -> DataFrame:
    """stories (id) with whether search has shown them often enough to be kept."""
    return stories.join(signals.select("id", "impressions", "clicks"), "id", "left").withColumn("protected", F.coalesce((F.col("impressions") >= least) | (F.col("clicks") > 0), F.lit(False)))

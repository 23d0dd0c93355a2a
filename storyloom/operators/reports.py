"""Coverage figures, weekly reports, search-console reports, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom.functions import dates, scores


def coverage(counts: DataFrame, n: str) -> DataFrame:
    """One row on how many sources stories have: buckets, shares, median, mean."""
    c = F.col(n)
    whole = F.count(F.lit(1))
    exact = {"one": c == 1, "two": c == 2, "three": c == 3, "four_up": c >= 4}
    return counts.agg(
        whole.alias("stories"),
        *(F.count_if(t).alias(k) for k, t in exact.items()),
        *(scores.percent(F.count_if(t), whole).alias(f"{k}_pct") for k, t in exact.items()),
        scores.percent(F.count_if(c >= 2), whole).alias("multi_pct"),
        F.percentile(c, F.lit(0.5)).alias("median"),
        scores.rounded(F.avg(c), 2).alias("mean"),
    )


def mix(rows: DataFrame, name: str, vocabulary: list[str]) -> DataFrame:
    """(label, n, pct) for every label of the vocabulary, zeros too, by count and then the vocabulary's order."""
    spark = rows.sparkSession
    table = spark.createDataFrame(list(enumerate(vocabulary)), "pos int, label string")
    counts = rows.groupBy(F.col(name).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    out = table.join(counts, "label", "left").crossJoin(F.broadcast(total))
    return out.select("pos", "label", F.coalesce("n", F.lit(0)).alias("n"), scores.percent(F.coalesce("n", F.lit(0)), F.col("total")).alias("pct"))


def publishers(members: DataFrame, story: str, name: str, most: int | None = None) -> DataFrame:
    out = members.where(F.trim(name) != "").select(story, F.trim(name).alias("name")).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")
    return out.limit(most) if most else out


def earliest(members: DataFrame, story: str, name: str, at: str) -> DataFrame:
    return members.where(F.trim(name) != "").groupBy(story).agg(F.min(F.struct(F.col(at).alias("at"), F.trim(name).alias("name"))).alias("m")).select(story, F.col("m.name").alias("first_publisher"), F.col("m.at").alias("first_at"))


def weekly(rows: DataFrame, at: str) -> DataFrame:
    """Rows by ISO week of the news day: count, and the change from the week before."""
    day = dates.news_day(at)
    weeks = rows.groupBy(dates.week_start(day).alias("week_start"), dates.week_id(day).alias("week_id")).agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("week_start")  # one row for each week
    last = F.when(F.lag("week_start").over(before) == F.date_sub("week_start", 7), F.lag("n").over(before))
    return weeks.select("week_start", "week_id", "n", last.alias("previous"), (F.col("n") - last).alias("delta"))


def feed_value(feeds: DataFrame, articles: DataFrame, stories: DataFrame, key: str) -> DataFrame:
    """A row for every feed: articles, those in stories of several sources, shares; zeros where nothing came."""
    counts = articles.join(stories, "story", "left").groupBy(key).agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("source_count") >= 2).alias("shared"))
    out = feeds.select(key).join(counts, key, "left")
    n, m = F.coalesce("articles", F.lit(0)), F.coalesce("shared", F.lit(0))
    return out.select(key, n.alias("articles"), m.alias("shared"), scores.rate(m, n).alias("shared_rate"), scores.percent(m, n).alias("shared_pct"))


def publications_ever(active: Column, union: Column, peak: Column) -> Column:
    return F.greatest(active, F.coalesce(union, F.lit(0)), F.coalesce(peak, F.lit(0)))


def velocity_to(events: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """(key, minutes): how long after its first event a key got its n-th."""
    w = W.partitionBy(key).orderBy(at)
    rows = events.withColumn("_n", F.row_number().over(w)).where(F.col("_n").isin(1, n))
    spans = rows.groupBy(key).agg(F.min(at).alias("first"), F.max(F.when(F.col("_n") == n, F.col(at))).alias("nth"))
    return spans.where("nth IS NOT NULL").select(key, dates.minutes_between(F.col("first"), F.col("nth")).alias("minutes"))


def pickup(events: DataFrame, key: str, at: str, hours: int = 24) -> DataFrame:
    """(key, n): events within so many hours of the first."""
    first = W.partitionBy(key)
    rows = events.select(key, F.col(at).alias("at"), F.min(at).over(first).alias("first"))
    return rows.groupBy(key).agg(F.count_if(F.unix_micros(F.col("at").cast("timestamp")) <= F.unix_micros(F.col("first").cast("timestamp")) + hours * 3_600_000_000).alias("n"))


def growth(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, first_value, last_value, grew)."""
    out = events.groupBy(key).agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))
    return out.withColumn("grew", F.col("last_value") > F.col("first_value"))


def flaps(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Keys whose value leaves and comes back, with the number of returns."""
    w = W.partitionBy(key).orderBy(*order)
    changes = events.withColumn("_last", F.lag(value).over(w)).where(F.col("_last").isNull() | (F.col("_last") != F.col(value)))
    return changes.groupBy(key, value).agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy(key).agg(F.sum(F.col("n") - 1).alias("returns"))


def grouping(rows: DataFrame, template: str, detail: str, weight: str, position: str, item: str) -> DataFrame:
    """Total, template and detail in one pass: distinct items, sums, weighted position."""
    # Items meet their group once; distinct counts then need no expansion by item.
    out = rows.groupingSets([[], [template], [template, detail]], template, detail).agg(
        F.grouping_id().alias("level"),
        F.count_distinct(item).alias("items"),
        F.sum(weight).alias("weight"),
        scores.rounded(F.sum(F.col(weight) * F.col(position)) / F.sum(weight), 4).alias("position"),
    )
    return out


def bucket_keys(n: Column) -> Column:
    """Exact and cumulative buckets that a count falls in; unknown for none."""
    exact = F.when(n >= 4, "4+").otherwise(n.cast("string"))
    more = F.array(F.when(n >= 2, F.lit("2+")), F.when(n >= 3, F.lit("3+")))
    return F.when(n.isNull(), F.array(F.lit("unknown"))).otherwise(F.concat(F.array(exact), F.filter(more, lambda x: x.isNotNull())))


def overlapping(rows: DataFrame, n: str, weight: str) -> DataFrame:
    return rows.select(F.explode(bucket_keys(F.col(n))).alias("bucket"), weight).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("weight"))


def ledger(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer merge: the earliest time, the largest count. Both: key, at, n."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, key, "full_outer").select(key, F.least("o.at", "n.at").alias("at"), F.greatest("o.n", "n.n").alias("n"))


def coherence(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, n): fields with several values for one key."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")
    return rows.select(*keys, pairs).where("x.value IS NOT NULL").groupBy(*keys, F.col("x.field").alias("field")).agg(F.count_distinct("x.value").alias("n")).where("n > 1")


def precision_recall(pairs: DataFrame, truth: str, found: str) -> DataFrame:
    tp, fp, fn = (F.count_if(t) for t in (F.col(truth) & F.col(found), ~F.col(truth) & F.col(found), F.col(truth) & ~F.col(found)))
    return pairs.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), scores.rate(tp, tp + fp, 4).alias("precision"), scores.rate(tp, tp + fn, 4).alias("recall"))


def concentration(rows: DataFrame, by: str, n: str) -> DataFrame:
    """By group, how many publications stories have: shares in percent, median, mean to one place."""
    c, whole = F.col(n), F.count(F.lit(1))
    shares = {"single": c <= 1, "two": c == 2, "three_up": c >= 3, "four_up": c >= 4, "multi": c >= 2}
    return rows.groupBy(by).agg(
        *(scores.percent(F.count_if(test), whole).alias(f"{name}_pct") for name, test in shares.items()),
        F.percentile(c, F.lit(0.5)).alias("median"),
        scores.rounded(F.avg(c), 1).alias("mean"),
    )


def top_label(rows: DataFrame, by: str, name: str, vocabulary: list[str]) -> DataFrame:
    """(by, label, n): the label with most rows; ties go to the first of the vocabulary, then to unknown ones by name."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, vocabulary)), F.col(name)), F.lit(0))
    place = F.when(place == 0, len(vocabulary) + 1).otherwise(place)
    counts = rows.groupBy(by, name).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), place.alias("place"), F.col(name).alias("label"))).alias("best"))
    return best.select(by, F.col("best.label").alias("label"), (-F.col("best.n")).alias("n"))


def most_covered(rows: DataFrame, by: str, ever: str, score: str, first_seen: str, slug: str, most: int) -> DataFrame:
    """The stories of each group with most publications ever; then by score (null as 0), first seen, slug."""
    order = W.partitionBy(by).orderBy(F.desc(ever), F.coalesce(score, F.lit(0.0)).desc(), F.asc(first_seen), F.asc(slug))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def reach(changes: DataFrame, key: str, first_seen: str, at: str, source: str, to: str, target: int) -> DataFrame:
    """(key, minutes): from the first sight of a story to the first change to so many publications.

    Only where it was seen below the target first: else when it got there is not known.
    """
    spans = changes.groupBy(key).agg(
        F.min(first_seen).alias("seen"),
        F.min(F.struct(F.col(at).alias("at"), F.col(source).alias("source"))).alias("first"),
        F.min(F.when(F.col(to) >= target, F.col(at))).alias("reached"),
    )
    return spans.where((F.col("first.source") < target) & F.col("reached").isNotNull()).select(key, dates.minutes_between(F.col("seen"), F.col("reached")).alias("minutes"))


def pickup_gain(changes: DataFrame, key: str, first_seen: str, at: str, source: str, to: str, hours: int = 24) -> DataFrame:
    """(key, source, to, gained, minutes): growth within so many hours of the first sight, where there is any."""
    within = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(first_seen).cast("timestamp")) <= hours * 3_600_000_000
    spans = changes.groupBy(key).agg(
        F.min(first_seen).alias("seen"),
        F.min(F.struct(F.col(at).alias("at"), F.col(source).alias("source"))).alias("first"),
        F.min(F.when(within, F.struct((-F.col(to)).alias("to"), F.col(at).alias("at")))).alias("best"),
    )
    gained = -F.col("best.to") - F.col("first.source")
    out = spans.where(F.col("best").isNotNull() & (gained > 0))
    return out.select(key, F.col("first.source").alias("source"), (-F.col("best.to")).alias("to"), gained.alias("gained"), dates.minutes_between(F.col("seen"), F.col("best.at")).alias("minutes"))


def content_bucket(kind: Column) -> Column:
    """news where it is unknown, opinion and press releases as they are, other for the rest."""
    return F.when(kind.isNull() | (kind == "news"), "news").when(kind.isin("opinion", "press_release"), kind).otherwise("other")

"""The permanent record: upserts that keep history, unions of sources, merges, retention, briefings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom import config
from storyloom.functions import dates
from storyloom.functions.text import col
from storyloom.operators.graph import flatten_pointers


def upsert(previous: DataFrame, current: DataFrame, key: str, watched: list[str], now: Column) -> DataFrame:
    """previous (key, watched, first_seen, last_modified) brought up to date by current (key, watched).

    first_seen is written once; last_modified moves only if a watched column changes.
    """
    live = F.col("c._live")
    joined = previous.alias("p").join(current.withColumn("_live", F.lit(True)).alias("c"), key, "full_outer")
    changed = F.lit(False)
    for name in watched:
        changed = changed | ~F.col(f"p.{name}").eqNullSafe(F.col(f"c.{name}"))
    new = F.col("p.first_seen").isNull()
    return joined.select(
        key,
        *(F.when(live, F.col(f"c.{n}")).otherwise(F.col(f"p.{n}")).alias(n) for n in watched),
        F.coalesce("p.first_seen", now).alias("first_seen"),
        F.when(new | (live & changed), now).otherwise(F.col("p.last_modified")).alias("last_modified"),
        F.when(new, "insert").when(live & changed, "update").otherwise("keep").alias("action"),
    )


def insert_ignore(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    return previous.unionByName(current.dropDuplicates(key).join(previous.select(*key), key, "left_anti"))


def new_ids(current: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    return current.select(key).distinct().join(archive.select(key), key, "left_anti")


def carry_over(registered: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Registered stories that the live set no longer has."""
    return registered.join(live.select(key), key, "left_anti")


def source_union(stored: DataFrame, active: DataFrame, now: Column) -> DataFrame:
    """(key, url, name, first_seen, last_seen) of stored and active (key, url, name) references."""
    s, a = stored.alias("s"), active.withColumn("_live", F.lit(True)).alias("a")
    return s.join(a, ["key", "url"], "full_outer").select(
        "key",
        "url",
        F.coalesce("a.name", "s.name").alias("name"),
        F.coalesce("s.first_seen", now).alias("first_seen"),
        F.when(F.col("a._live"), now).otherwise(F.col("s.last_seen")).alias("last_seen"),
    )


def diff(previous: DataFrame, current: DataFrame, key: str, at: Column) -> DataFrame:
    """Update events between two generations (key, title, source_count, category), in the order headline, coverage, category."""
    p, c = previous.alias("p"), current.alias("c")
    event = lambda test, n, kind, old, new: F.when(test, F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), old.cast("string").alias("old"), new.cast("string").alias("new")))
    differs = lambda name: ~F.col(f"p.{name}").eqNullSafe(F.col(f"c.{name}"))
    found = F.array(*(event(differs(name), n, kind, F.col(f"p.{name}"), F.col(f"c.{name}")) for n, (name, kind) in enumerate((("title", "headline_updated"), ("source_count", "coverage_change"), ("category", "category_changed")))))
    rows = p.join(c, key).select(key, F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e"))
    return rows.select(key, "e.n", "e.kind", "e.old", "e.new", at.alias("at"))


def last_events(events: DataFrame, key: str, order: list[Column], most: int = config.HISTORY_CAP) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def without_churn(history: Column, hours: int = config.CHURN_HOURS, most: int = config.DISPLAY_CAP) -> Column:
    """Events struct<kind, at, old, new> without a coverage change that the next one takes back within hours, nor category changes; the last ones."""
    ordered = F.array_sort(F.filter(col(history), lambda e: e["kind"] != "category_changed"), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    empty = F.filter(col(history), lambda e: F.lit(False))

    def step(kept, e):
        cover = F.filter(kept, lambda k: k["kind"] == "coverage_change")
        last = F.element_at(F.when(F.size(cover) > 0, cover).otherwise(F.array(e)), -1)
        undone = (F.size(cover) > 0) & (e["kind"] == "coverage_change") & (last["old"] == e["new"]) & (last["new"] == e["old"]) & (dates.hours_between(last["at"], e["at"]) <= hours)
        without = F.filter(kept, lambda k: ~((k["kind"] == "coverage_change") & (k["at"] == last["at"])))
        return F.when(undone, without).otherwise(F.concat(kept, F.array(e)))

    kept = F.aggregate(ordered, empty, step)
    return F.when(F.size(kept) > most, F.slice(kept, -most, most)).otherwise(kept)


def hysteresis(previous: Column, candidate: Column, streak_of: Column, streak: Column, moved: Column, need: int = 2) -> Column:
    """struct<category, candidate, count>: a new label holds if it is the old one, members moved by more than one, or it came often enough in a row."""
    count = F.when(candidate == streak_of, F.coalesce(streak, F.lit(0)) + 1).otherwise(F.lit(1))
    adopt = previous.isNull() | (candidate == previous) | (moved > 1) | (count >= need)
    return F.struct(F.when(adopt, candidate).otherwise(previous).alias("category"), F.when(adopt, F.lit(None)).otherwise(candidate).alias("candidate"), F.when(adopt, F.lit(0)).otherwise(count).alias("count"))


def membership_change(previous: DataFrame, current: DataFrame, key: str, member: str) -> DataFrame:
    """(key, moved): size of the symmetric difference of members."""
    p, c = previous.select(key, member, F.lit(1).alias("p")), current.select(key, member, F.lit(1).alias("c"))
    return p.join(c, [key, member], "full_outer").groupBy(key).agg(F.count_if(F.col("p").isNull() | F.col("c").isNull()).alias("moved"))


def merges(vanished: DataFrame, urls: DataFrame) -> DataFrame:
    """(node, target, votes): each vanished story (node, url) goes to the living one that has most of its URLs."""
    votes = vanished.join(urls, "url").groupBy("node", "target").agg(F.count(F.lit(1)).alias("votes"))
    order = W.partitionBy("node").orderBy(F.desc("votes"), "target")
    return votes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def repoint(pointers: DataFrame, fresh: DataFrame) -> DataFrame:
    """Old and fresh pointers, each one hop."""
    old = pointers.join(fresh.select("node"), "node", "left_anti")
    return flatten_pointers(old.unionByName(fresh.select("node", "target")))


def retained(tables: dict[str, tuple[DataFrame, str, int]], now: Column) -> dict[str, DataFrame]:
    """Each (frame, time column, days) without what is older."""
    return {name: frame.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days))) for name, (frame, at, days) in tables.items()}


def briefing(stories: DataFrame, day: Column, most: int = 10) -> DataFrame:
    best = stories.orderBy("rank").limit(most)
    return best.select(day.alias("briefing_date"), "rank", "grp", "title", "score")


def days(archive: DataFrame, at: str, most: int = 400) -> DataFrame:
    return archive.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(most)


def compact(stories: DataFrame, members: DataFrame) -> DataFrame:
    """The wire form: stories that name their members by id, in order."""
    ids = members.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"]).alias("article_ids"))
    return stories.join(ids, "grp")


def expand(compacted: DataFrame, articles: DataFrame) -> DataFrame:
    """(grp, pos, id and the article's columns): the inverse; ids without an article are left out."""
    return compacted.select("grp", F.posexplode("article_ids").alias("pos", "id")).join(articles, "id")


def within_budget(stories: DataFrame, size: Column, most: int) -> DataFrame:
    """The best stories whose sizes add up to at most so many bytes, by a running sum over the ranked report."""
    upto = F.sum(size).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return stories.withColumn("_upto", upto).where(F.col("_upto") <= most).drop("_upto")


def version(stories: DataFrame, now: Column) -> DataFrame:
    """One row: the generation's name, from its time and a hash of the ranked ids, which are hashed in parts first."""
    parts = stories.groupBy(F.floor(F.col("rank") / 1000).alias("part")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "grp"))), lambda s: s["grp"].cast("string")), "|"), 256).alias("digest"))
    whole = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda s: s["digest"]), "|"), 256)
    return parts.agg(F.concat_ws("-", F.date_format(now, "yyyyMMddHHmmss"), F.substring(whole, 1, 6)).alias("dataset_version"))


def sitemap(stories: DataFrame, now: Column, hours: int = 48, most: int = 1000) -> DataFrame:
    """(loc, lastmod) of stories covered and first published lately, newest first, each location once."""
    floor = now - F.make_dt_interval(hours=F.lit(hours))
    recent = stories.where((F.col("last_at") >= floor) & (F.col("first_at") >= floor))
    return recent.groupBy("loc").agg(F.max("last_at").alias("lastmod")).orderBy(F.desc("lastmod"), "loc").limit(most)

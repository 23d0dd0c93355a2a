"""Archive rows whose sources and history are JSON text: parsed once as variants, malformed values as nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import col


def elements(json: Column | str) -> Column:
    """array<variant> of a JSON array; empty for anything else, broken text and null included."""
    parsed = F.try_parse_json(col(json))
    return F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.array().cast("array<variant>"))


def field(item: Column, name: str) -> Column:
    """The text of a field; null where there is none or the item is no object."""
    return F.try_variant_get(item, f"$.{name}", "string")


def digits(text: Column) -> Column:
    """A number written in digits only; null for all else, and for what no int holds."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


def union_rows(archive: DataFrame) -> DataFrame:
    """archive with union_sources, union_publications, stamped, peak_history and history_events from its sources and history.

    A publication is a distinct trimmed name that is not empty.  stamped: some source has a first sighting.  The peak is over both ends of
    changes of coverage, null without any number.
    """
    rows = archive.withColumn("_s", elements("sources")).withColumn("_h", elements("history"))
    names = F.array_distinct(F.filter(F.transform("_s", lambda s: F.nullif(F.trim(field(s, "name")), F.lit(""))), lambda n: n.isNotNull()))
    changes = F.filter("_h", lambda e: field(e, "kind") == "coverage_change")
    ends = F.flatten(F.transform(changes, lambda e: F.array(digits(field(e, "from")), digits(field(e, "to")))))
    return rows.select(
        *archive.columns,
        F.size("_s").alias("union_sources"),
        F.size(names).alias("union_publications"),
        F.exists("_s", lambda s: F.try_variant_get(s, "$.firstSeenAt", "variant").isNotNull()).alias("stamped"),
        F.array_max(ends).alias("peak_history"),
        F.size("_h").alias("history_events"),
    )


def references(archive: DataFrame, key: str) -> DataFrame:
    """(key, pos, name, url, first_seen): one row for each source, in order."""
    items = archive.select(key, F.posexplode(elements("sources")).alias("pos", "_s"))
    return items.select(key, "pos", field(F.col("_s"), "name").alias("name"), field(F.col("_s"), "url").alias("url"), field(F.col("_s"), "firstSeenAt").alias("first_seen"))


def events(archive: DataFrame, key: str) -> DataFrame:
    """(key, pos, kind, from, to, at): one row for each event of the history."""
    items = archive.select(key, F.posexplode(elements("history")).alias("pos", "_e"))
    return items.select(key, "pos", *(field(F.col("_e"), name).alias(name) for name in ("kind", "from", "to", "at")))


def as_story(archive: DataFrame) -> DataFrame:
    """Archived rows as stories: names of sources and entities as arrays, times as instants in ISO form, a merge target or null."""
    iso = lambda name: F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    names = F.transform(elements("sources"), lambda s: field(s, "name"))
    entities = F.filter(F.transform(elements("entities"), lambda e: F.try_variant_get(e, "$", "string")), lambda e: e.isNotNull())
    return archive.select("cluster_id", "title", iso("first_seen").alias("first_seen_at"), iso("last_modified").alias("last_modified_at"), "source_count", names.alias("source_names"), entities.alias("entity_names"), F.nullif("merged_into", F.lit("")).alias("merged_into"))

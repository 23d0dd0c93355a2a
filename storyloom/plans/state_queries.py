"""Stateful streams and generations over the sample tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from storyloom.checkpoints import shared_folder
from storyloom.plans.registry import query
from storyloom.sources.tables import table
from storyloom.streaming import flows, generations, registry

SHARDS = 16


def bursts(spark, sf_dir):
    """Events as what happens to stories (users) of a shard: purchases drain its registry, errors are failed bursts, all else makes a story public."""
    kind = F.when(F.col("event_type") == "purchase", registry.DRAIN).when(F.col("event_type") == "error", registry.FAILED).otherwise(registry.PUBLIC)
    return table(spark, sf_dir, "events").select((F.col("user_id") % SHARDS).alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("user_id").alias("story"))


@query(f"""WITH e AS (SELECT user_id % {SHARDS} AS key, event_id, ts, event_type, user_id AS story FROM events), p AS (SELECT * FROM e WHERE event_type NOT IN ('purchase', 'error')), d AS (SELECT * FROM e WHERE event_type = 'purchase'),
j AS (SELECT p.key, p.story, p.ts, d.event_id AS burst FROM p ASOF JOIN d ON p.key = d.key AND p.ts <= d.ts) SELECT key, burst, story, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS seen FROM j GROUP BY key, burst, story""")
def registry_drains(spark, sf_dir):
    """The registry over the events as a stream; a last event long after all others lets the watermark pass them."""
    folder = f"{shared_folder(spark).rstrip('/')}/bursts-{uuid.uuid4().hex}"
    rows = bursts(spark, sf_dir)
    rows.write.parquet(f"{folder}/events")
    end = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit(-1).cast("long").alias("seq"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(registry.FAILED).alias("kind"), F.lit(0).cast("long").alias("story"))
    end.write.parquet(f"{folder}/end")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(folder)
    found = flows.finished(registry.drained(stream, "400 days", 24 * 3_600_000), "registry", "append")
    return found.select("key", "burst", "story", F.date_format("seen", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("seen"))


_GENERATION = {
    "articles": "SELECT doc_id::BIGINT AS k FROM documents",
    "clusters": "SELECT min(doc_id)::BIGINT AS k FROM documents GROUP BY sha256(text)",
    "members": "SELECT doc_id::BIGINT AS k FROM documents WHERE text IS NOT NULL",
    "rankings": "SELECT l_orderkey::BIGINT AS k FROM lineitem",
    "sources": "SELECT DISTINCT substr(source, 4)::BIGINT AS k FROM documents",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM ({sql})" for name, sql in _GENERATION.items()))
def persisted_generation(spark, sf_dir):
    """Five tables published as one generation, as its readers see them; a generation before it is superseded."""
    docs = table(spark, sf_dir, "documents")
    key = lambda c: F.col(c).cast("long").alias("k")
    tables = {
        "articles": docs.select(key("doc_id")),
        "clusters": docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("t")).agg(F.min("doc_id").cast("long").alias("k")).select("k"),
        "members": docs.where(F.col("text").isNotNull()).select(key("doc_id")),
        "rankings": table(spark, sf_dir, "lineitem").select(key("l_orderkey")),
        "sources": docs.select(F.substring("source", 4, 9).cast("long").alias("k")).distinct(),
    }
    path = f"{shared_folder(spark).rstrip('/')}/generations-{uuid.uuid4().hex}"
    generations.publish(spark, {"articles": tables["articles"].limit(1)}, path)
    generations.publish(spark, tables, path)
    found = generations.read(spark, path)
    each = [frame.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")) for name, frame in found.items()]
    return reduce(lambda a, b: a.unionByName(b), each)

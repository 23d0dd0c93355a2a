"""Structured Streaming: windows with late data, duplicates, state per story, idempotent generations."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storyloom import config
from storyloom.checkpoints import shared_folder


def events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream, its times as instants."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(rows: DataFrame, late: str = "72 hours", size: str = "1 day") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def sliding(rows: DataFrame, late: str = "72 hours", size: str = "3 hours", slide: str = "1 hour") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(rows: DataFrame, late: str = "72 hours", gap: str = "6 hours") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(rows: DataFrame, keys: list[str], late: str = "72 hours") -> DataFrame:
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def accepted(rows: DataFrame, now) -> DataFrame:
    """Rows that are neither too old nor in the future."""
    return rows.where((F.col("ts") >= now - F.make_dt_interval(hours=F.lit(config.MAX_AGE_HOURS))) & (F.col("ts") <= now + F.make_dt_interval(mins=F.lit(config.FUTURE_MINUTES))))


def stable_labels(rows: DataFrame, need: int = 2) -> DataFrame:
    """(user_id, label, changes): a label is taken over once it has come so often in a row. State: label, candidate, streak, changes."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        label, candidate, streak, changes = state.get if state.exists else (None, None, 0, 0)
        for batch in batches:
            for value in batch.sort_values(["ts", "event_id"])["event_type"]:
                if label is None or value == label:
                    label, candidate, streak = value, None, 0
                    continue
                streak = streak + 1 if value == candidate else 1
                candidate = value
                if streak >= need:
                    label, candidate, streak, changes = value, None, 0, changes + 1
        state.update((label, candidate, streak, changes))
        yield pd.DataFrame({"user_id": [key[0]], "label": [label], "changes": [changes]})

    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, label string, changes long", "label string, candidate string, streak int, changes long", "update", GroupStateTimeout.NoTimeout)


def finished(frame: DataFrame, name: str, mode: str, folder: str | None = None) -> DataFrame:
    """Run a bounded stream to its end and return what it wrote, as Parquet in the folder that the cluster shares.

    In mode complete the last batch's table is the result; in the others every batch adds its rows.  A batch
    that runs again after a failure replaces itself.
    """
    root = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    path = f"{root}/rows"

    frame.sparkSession.createDataFrame([], frame.schema).write.parquet(path if mode == "complete" else f"{path}/batch=none")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    writer = frame.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", folder or f"{root}/state").start().awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).option("recursiveFileLookup", True).parquet(path)


def publish(rows: DataFrame, path: str, folder: str, step=None):
    """Write each micro-batch as one generation, once: a batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        (step(batch) if step else batch).withColumn("generation", F.lit(number)).write.mode("overwrite").parquet(f"{path}/generation={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", folder).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest generation."""
    every = spark.read.parquet(path)
    return every.where(F.col("generation") == every.agg(F.max("generation")).first()[0])


def due(last_minutes: float | None, interval: int = 25, new_day: bool = False) -> bool:
    """Whether a generation may be persisted now: after the interval, or because the news day changed."""
    return last_minutes is None or new_day or last_minutes >= interval

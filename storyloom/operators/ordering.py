"""Places in a total order without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom.checkpoints import checkpoint


def with_place(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1: range partitions, counted, then numbered within."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = checkpoint(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # One row for each partition.
    within = F.row_number().over(W.partitionBy("_part").orderBy("_id"))
    return numbered.join(F.broadcast(before), "_part").withColumn(name, within + F.col("_before")).drop("_part", "_id", "_before")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page; a number outside the range is moved into it."""
    total = rows.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def top_of_each(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def hashed_sample(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """A sample that depends on keys only, so that it is the same in every run."""
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))

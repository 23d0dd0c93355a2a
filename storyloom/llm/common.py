"""What the operators share: columns, places for intermediate results, running totals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.checkpoints import checkpoint, shared_folder

__all__ = ["SPACES", "checkpoint", "documents", "named", "same", "shared_folder", "text_of", "written"]

#: The white space of all contracts: space, \t, \n, \v, \f and \r.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def named(name: str) -> Column:
    """The column of this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def written(frame: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.parquet(path)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)

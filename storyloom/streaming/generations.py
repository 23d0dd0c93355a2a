"""Several tables as one generation: all of them can be read, or none.

Tables are written to a folder that nobody knows of; last, a manifest of one file names them.  Spark moves the file in
place when the write is committed, so readers see whole generations only, and a write that fails, or is tried again, leaves the
generation before it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "generation long, name string, path string, n_rows long"


def manifests(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_number(spark: SparkSession, path: str) -> int:
    """0 before the first generation."""
    known = manifests(spark, path)
    return (known.agg(F.max("generation")).first()[0] or 0) if known is not None else 0


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> int:
    """Write the tables as the next generation; its number. Of two writers of one number the second fails and leaves nothing to read."""
    number, folder = latest_number(spark, path) + 1, f"{path}/data/{uuid.uuid4().hex}"
    rows = []
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{name}")
        rows.append((number, name, f"{folder}/{name}", spark.read.parquet(f"{folder}/{name}").count()))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/{number}")
    return number


def read(spark: SparkSession, path: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a generation, the latest by default."""
    known = manifests(spark, path)
    if known is None:
        return {}
    number = latest_number(spark, path) if number is None else number
    return {r.name: spark.read.parquet(r.path) for r in known.where(F.col("generation") == number).collect()}

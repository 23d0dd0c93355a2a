"""Exact dedup with a split of heavy hitters.

Texts are equal when they are identical without white space; their SHA-256 digests stand for
them.  A Misra-Gries summary (Spark's freqItems) names at most ``1 / support`` digests that
may hold more than ``support`` of all rows.  These candidates are counted exactly; the winners
of those that pass are broadcast, at most ``1 / support`` rows whatever the input, and decide
their copies on the map side.  All other digests are shuffled in the ordinary way.

Defined results: a null text is an empty one, and all empty texts are equal.  A null doc_id comes
after all others.  Of rows that are alike in everything exactly one is kept.  A text of any length is
digested whole.  An empty table gives an empty result.  Columns other than doc_id and text are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import SPACES, checkpoint, same, text_of

SUPPORT = 0.001


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, and the order in which rows of one digest are preferred."""
    text = text_of()
    return docs.select(
        "doc_id",
        F.sha2(F.regexp_replace(text, SPACES, "").cast("binary"), 256).alias("digest"),  # a string: freqItems tells binary values apart by identity
        F.struct(
            (-F.length(text)).alias("size"),
            F.col("doc_id").isNull().alias("unnamed"),
            F.col("doc_id").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("place"),
    )


def assign(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = checkpoint(digests(docs))
    total = rows.count()
    frequent = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    group = [F.count(F.lit(1)).alias("group_size"), F.min("place").alias("winner")]
    winners = checkpoint(rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(*group).where(F.col("group_size") > support * total))
    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = rest.join(rest.groupBy("digest").agg(*group), "digest")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("place.row") == F.col("winner.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The documents that stay, with all their columns. Rows that share a doc_id count as one document."""
    stay = assign(docs, support).where("kept").select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, same(F.col("doc_id"), F.col("_stay")), "left_semi")


#: DuckDB's form of assign() over documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
"""

"""Vectors as evidence: nearest neighbours, votes, gates that a provider's answer must pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.ordering import top_of_each


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_list()).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


#: Cosines that a task holds at a time; choosing among them takes about three times their memory.
CELLS = 1 << 20


def _best(asked: pd.DataFrame, given: pd.DataFrame, k: int, cells: int = CELLS) -> pd.DataFrame:
    """The k nearest of given for each row of asked, ties by the lower vec_id; products of so many cells at a time."""
    given = given.sort_values("vec_id", kind="stable")
    own, base = given["vec_id"].to_numpy(), _unit(given["embedding"])
    n, rows, found = min(k, len(own)), max(1, cells // len(own)), []
    for at in range(0, len(asked), rows):
        part = asked.iloc[at : at + rows]
        ids = part["vec_id"].to_numpy()
        s = _unit(part["embedding"]) @ base.T
        s[ids[:, None] == own[None, :]] = -np.inf
        best = np.argpartition(-s, n - 1, axis=1)[:, :n]
        least = np.take_along_axis(s, best, 1).min(axis=1, keepdims=True)
        for i in np.flatnonzero((s >= least).sum(axis=1) > n):
            best[i] = np.argsort(-s[i], kind="stable")[:n]
        found.append(pd.DataFrame({"query": np.repeat(ids, n), "vec_id": own[best].ravel(), "cosine": np.take_along_axis(s, best, 1).ravel()}))
    return pd.concat(found)


def nearest(queries: DataFrame, base: DataFrame, k: int, block: int = 16384) -> DataFrame:
    """(query, vec_id, cosine): the k nearest of base for each query, never itself. Both: vec_id, embedding.

    Queries are dealt into blocks and the base into chunks of about so many rows by a hash of the id; each
    block meets each chunk in one group, which keeps k of the chunk for each query, and a window merges
    these.  No vector passes through the driver, and a group's size does not depend on the tables'.
    Null embeddings neither ask nor answer; a vector of zeros has cosine 0 with all.
    """
    asked, given = (rows.select("vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL") for rows in (queries, base))
    blocks = max(1, -(-asked.count() // block))
    chunks = max(base.sparkSession.sparkContext.defaultParallelism, -(-given.count() // block))
    dealt = lambda rows, own, n, other, m: rows.select(
        "*", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
    )
    left = dealt(asked, "_block", blocks, "_chunk", chunks).groupBy("_block", "_chunk")
    right = dealt(given, "_chunk", chunks, "_block", blocks).groupBy("_block", "_chunk")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"query": [], "vec_id": [], "cosine": []})
        return _best(x, y, k)

    out = left.cogroup(right).applyInPandas(run, "query long, vec_id long, cosine double").where("cosine > -2")
    return top_of_each(out, ["query"], [F.desc("cosine"), F.asc("vec_id")], k)


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(query, label, weight): the label with most similarity among a query's neighbours."""
    sums = neighbours.join(labels, "vec_id").groupBy("query", "label").agg(F.round(F.sum("cosine"), 6).alias("weight"))
    return top_of_each(sums, ["query"], [F.desc("weight"), F.asc("label")], 1)


def override(category: Column, proposed: Column, confidence: Column, least: float = 0.85) -> Column:
    """Only a general story takes a proposal, and only a confident one."""
    return F.when((category == "general") & (confidence >= least) & (proposed != "general"), proposed).otherwise(category)


def merge_allowed(same: Column, confidence: Column, evidence: Column, least: float = 0.9) -> Column:
    return (same == "same_event") & (confidence >= least) & evidence


def cache_key(a: Column, b: Column) -> Column:
    """The same for a pair in either order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array(a.cast("string"), b.cast("string"))), "|").cast("binary"), 256), 1, 24)


def capped(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """Requests within a refresh's budget."""
    return top_of_each(rows, [key], order, most)

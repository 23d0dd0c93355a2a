"""Removal of boilerplate lines: lines that stand on many sites.

A line's key is a 128-bit hash of its words.  HyperLogLog sketches of the sites (sources) of
each line merge by aggregation, on the map side first.  An estimate well above MIN_SITES makes
a line boilerplate, one well below does not; lines whose estimate lies within three standard
errors of the threshold get an exact count of distinct sites.  The first occurrence of a
boilerplate line (by doc_id, then place) stays, all others go.

Every line with a word counts, menus of one word included.  A document with one such line is
content and not boilerplate: its line counts for the spread but stays.  Texts are shuffled once
at most, to meet their list of lines to remove, and not at all where Spark can broadcast the lists.

Defined results: a null text has no lines and stays null; a null source is a site of its own; a
null doc_id comes after all others.  Where rows share a doc_id and hold the line at the same
place, each of them holds the first occurrence and keeps it; repeated rows are treated alike, one
by one.  A text of any length is split as a whole, within one task.  Other columns stay as they
are, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import SPACES, checkpoint, named, written

MIN_SITES = 10
LG_K = 10
#: A text with words on two lines or more; anchored, or each place of a long line would be tried to its end.
SEVERAL = r"\A[\x20\x09-\x0D]*[^\x20\x09-\x0D][^\n]*\n[\x20\x09-\x0D]*[^\x20\x09-\x0D]"
ERROR = 1.04 / 2 ** (LG_K / 2)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("_k2"))


def _lines(docs: DataFrame) -> DataFrame:
    """_k1, _k2 of the document, whether it has several lines with words, site, place, and h1, h2 of each of them."""
    rows = _keyed(docs.select("doc_id", "text", "source"))
    site = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    several = F.col("text").rlike(SEVERAL)
    lines = rows.select("doc_id", "_k1", "_k2", several.alias("several"), site.alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = F.regexp_replace(F.regexp_replace("line", SPACES, " "), "^ | $", "")
    lines = lines.select("*", words.alias("words")).where("words <> ''")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("pos"))
    return lines.select("_k1", "_k2", "several", "site", "pos", place.alias("place"), F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 and the first place of each boilerplate line."""
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("place").alias("first"))
    rated = sketches.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - 3 * ERROR) - 1)
    rated = checkpoint(rated)
    near = rated.where(F.col("sites") <= min_sites * (1 + 3 * ERROR) + 1)
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1)).groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites)
    sure = rated.where(F.col("sites") > min_sites * (1 + 3 * ERROR) + 1)
    return checkpoint(sure.select("h1", "h2", "first").unionByName(near.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first")))


def _cleaned(docs: DataFrame, min_sites: int) -> DataFrame:
    """docs with _lines (all lines), _left (places of those that stay) and _text (what is left)."""
    lines = written(_lines(docs), "line-keys")  # read three times
    found = boilerplate(lines, min_sites)
    copies = lines.join(found, ["h1", "h2"]).where(F.col("several") & (F.col("place") != F.col("first")))
    gone = copies.groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("_gone"))
    rows = _keyed(docs).join(gone, ["_k1", "_k2"], "left").withColumn("_lines", F.split("text", "\n"))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    rows = rows.withColumn("_left", F.when(F.col("_gone").isNotNull(), F.array_except(every, "_gone")))
    left = F.array_join(F.transform("_left", lambda i: F.get("_lines", i)), "\n")
    return rows.withColumn("_text", F.when(F.col("_gone").isNotNull(), left).otherwise(F.col("text")))


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256."""
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines"))
    return _cleaned(docs.select("doc_id", "text", "source"), min_sites).select(
        "doc_id",
        n.cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def apply(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents without boilerplate; those of which no word is left go."""
    names = docs.columns
    packed = docs.select("doc_id", "text", "source", F.struct(*map(named, names)).alias("_in"))
    rows = _cleaned(packed, min_sites).where(F.col("_gone").isNull() | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("_text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("_gone").isNull(), F.col("_in.n_chars")).otherwise(F.length("_text")).cast(dict(docs.dtypes)["n_chars"])
    return rows.select(*(new.get(c, F.col("_in")[c]).alias(c) for c in names))


#: DuckDB's form of report() over documents.
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, 'null') AS site, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, site, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM t),
w AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS words FROM l),
k AS (SELECT *, count(DISTINCT site) OVER (PARTITION BY words) AS sites, rank() OVER (PARTITION BY words ORDER BY doc_id NULLS LAST, pos) AS nth,
             count(*) OVER (PARTITION BY r) AS own FROM w WHERE words <> ''),
g AS (SELECT r, pos FROM k WHERE sites >= {MIN_SITES} AND nth > 1 AND own > 1)
SELECT t.doc_id, count(l.pos) AS n_lines, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '')) AS kept_sha256
FROM t LEFT JOIN l USING (r) LEFT JOIN g USING (r, pos) GROUP BY r, t.doc_id
"""

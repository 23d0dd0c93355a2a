"""Dictionaries of any size over texts: which terms stand where, by an equi-join of words.

A term is one word or several with single spaces between them; it stands in a text where it is bounded by
characters other than a-z and 0-9, in either case of letters, also with a plural s at its end.  Texts are split to words
once.  Words that begin no term go; what follows the others, up to the longest term, is compared with
the terms that begin so.  Spark broadcasts the terms or shuffles both sides, by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom.functions.text import col


def words(text: Column | str) -> Column:
    """Lower-case words in order; an empty one stands for anything but a single space between two words. One pass over the text."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z0-9]+)|[^a-z0-9]{2,}|[^a-z0-9 ]"), 1)


def prepared(terms: DataFrame) -> DataFrame:
    """term, head (its first word), also with the plural of one-word terms; rest (the other words), size."""
    split = terms.select("term").distinct().withColumn("_w", F.split(F.lower(F.trim("term")), " +")).where(F.length(F.trim("term")) > 0)
    split = split.withColumn("size", F.size("_w"))
    last = lambda w: F.element_at(w, -1)
    forms = F.array(F.col("_w"), F.concat(F.slice("_w", F.lit(1), F.col("size") - 1), F.array(F.concat(last(F.col("_w")), F.lit("s")))))
    return split.select("term", "size", F.explode(forms).alias("_f")).select("term", "size", F.col("_f")[0].alias("head"), F.array_join(F.slice("_f", F.lit(2), F.col("size")), " ").alias("rest"))


def matches(texts: DataFrame, terms: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, term, at, size, form): every place where a term stands, overlapping ones as well, and as what. key: columns that name a text."""
    known = prepared(terms)
    longest = known.agg(F.max("size")).first()[0] or 0
    split = texts.select(*key, words(text).alias("_words"))
    # A row has the words that a term may still have, not those of its text. Of the plain posexplode Spark would infer a filter on its
    # argument, for which the text is split again; the row of nulls of the outer one meets no term.
    after = [f"_w{i}" for i in range(1, longest)]
    single = split.select(*key, "_words", F.posexplode_outer("_words").alias("at", "head")).select(*key, "at", "head", *(F.get("_words", F.col("at") + i).alias(name) for i, name in enumerate(after, 1)))
    follow = F.array_join(F.slice(F.array(*after), F.lit(1), F.col("size") - 1), " ") if after else F.lit("")
    found = single.join(known, "head") if longest else single.join(known, "head").limit(0)
    return found.where((F.col("size") == 1) | (follow == F.col("rest"))).select(*key, "term", "at", "size", F.trim(F.concat_ws(" ", "head", "rest")).alias("form"))


def distinct_hits(texts: DataFrame, terms: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, term) once for each text and term.

    Words of a text are made distinct before the join, so that a frequent word costs a text one row.
    """
    known = prepared(terms)
    split = texts.select(*key, words(text).alias("_words"))
    ones = split.select(*key, F.explode(F.array_distinct("_words")).alias("head")).join(known.where("size = 1"), "head").select(*key, "term")
    several = known.where("size > 1")
    if several.isEmpty():
        return ones.distinct()
    return ones.unionByName(matches(texts, terms.join(several.select("term").distinct(), "term", "left_semi"), key, text).select(*key, "term")).distinct()


def resolved(found: DataFrame, key: list[str]) -> DataFrame:
    """matches() without those that overlap one that begins earlier, or at the same place and is longer: leftmost-longest.

    Only matches that touch others are followed one by one, within their text.
    """
    best = found.groupBy(*key, "at").agg(F.max(F.struct("size", "term", "form")).alias("_b")).select(*key, "at", "_b.size", "_b.term", "_b.form")
    order = W.partitionBy(*key).orderBy("at")
    reach = F.max(F.col("at") + F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = best.withColumn("_new", (F.coalesce(reach, F.lit(0)) <= F.col("at")).cast("int")).withColumn("_run", F.sum("_new").over(order))
    chain = F.sort_array(F.collect_list(F.struct("at", "size", "term", "form")))  # overlapping matches of one text
    empty = F.array().cast("array<struct<at:int,size:int,term:string,form:string>>")

    def step(kept, m):
        last = F.element_at(kept, -1)
        return F.when((F.size(kept) == 0) | (m["at"] >= last["at"] + last["size"]), F.concat(kept, F.array(m))).otherwise(kept)

    kept = runs.groupBy(*key, "_run").agg(chain.alias("_c")).select(*key, F.explode(F.when(F.size("_c") == 1, F.col("_c")).otherwise(F.aggregate("_c", empty, step))).alias("_m"))
    return kept.select(*key, "_m.term", "_m.at", "_m.size", "_m.form")


def weighed(articles: DataFrame, terms: DataFrame, title_weight: int = 3, phrase_bonus: int = 1, text_weight: int = 1) -> DataFrame:
    """(ord, category, score): terms (term, category, weight) in titles and descriptions.

    A term in the title counts title_weight (a phrase phrase_bonus more), else in the description text_weight; a negative
    weight takes 2 away wherever the term stands.  Categories at zero or below go.
    """
    both = articles.select("ord", F.lit(1).alias("part"), F.col("title").alias("_text")).unionByName(articles.select("ord", F.lit(0), F.col("description")).toDF("ord", "part", "_text"))
    found = distinct_hits(both, terms, ["ord", "part"], "_text").groupBy("ord", "term").agg(F.max("part").alias("part"))
    phrase = F.when(F.contains(F.trim("term"), F.lit(" ")), phrase_bonus).otherwise(0)
    points = F.when(F.col("weight") < 0, F.col("weight")).when(F.col("part") == 1, title_weight + phrase).otherwise(text_weight)
    sums = found.join(terms.select("term", "category", "weight"), "term").groupBy("ord", "category").agg(F.sum(points).alias("score"), F.max(F.col("weight") > 0).alias("_own"))
    return sums.where("_own AND score > 0").select("ord", "category", F.col("score").cast("long").alias("score"))


def sections(articles: DataFrame, terms: DataFrame, money: Column, least: int = 2) -> DataFrame:
    """(ord, category, confidence, categories) of every article, from weighed().

    general below the least score and on a tie at the top, unless a money word makes a tie with business a business story.
    """
    scored = weighed(articles, terms)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("category").alias("c"))))  # one for each category
    best = scored.groupBy("ord").agg(ranked.alias("_r")).select("ord", F.transform("_r", lambda x: F.struct((-x["s"]).alias("score"), x["c"].alias("category"))).alias("_r"))
    rows = articles.select("ord", money.alias("_money")).join(best, "ord", "left").withColumn("_top", F.col("_r")[0]["score"])
    tied = F.transform(F.filter("_r", lambda x: x["score"] == F.col("_top")), lambda x: x["category"])
    rows = rows.withColumn("_tied", tied)
    business = (F.size("_tied") > 1) & F.array_contains("_tied", "business") & F.col("_money") & (F.col("_top") >= least)
    rows = rows.withColumn("_business", business)
    vague = F.col("_r").isNull() | (F.col("_top") < least) | ((F.size("_tied") > 1) & ~F.col("_business"))
    others = F.filter("_tied", lambda c: c != "general")
    strong = F.transform(F.filter("_r", lambda x: x["score"] >= F.greatest(F.lit(3.0), F.col("_top") * 0.4)), lambda x: x["category"])
    primary = F.when(F.col("_business"), "business").otherwise(F.col("_tied")[0])
    first = F.concat(F.array(primary), F.filter(strong, lambda c: c != primary))
    categories = F.when(F.col("_r").isNull(), F.array(F.lit("general"))).when(vague, F.concat(F.array(F.lit("general")), F.when(F.size("_tied") > 1, others).otherwise(F.array().cast("array<string>")))).otherwise(first)
    second = F.coalesce(F.get("_r", F.lit(1))["score"], F.lit(0))
    confidence = F.when(vague, 0.0).when(F.size("_r") == 1, 1.0).otherwise((F.col("_top") - second) / F.col("_top"))
    return rows.select("ord", F.when(vague, "general").otherwise(primary).alias("category"), confidence.alias("confidence"), F.slice(categories, 1, 3).alias("categories"))


def places(articles: DataFrame, terms: DataFrame, named: dict[str, Column], hint: Column | None = None) -> DataFrame:
    """(ord, country, confidence, scores of the two countries) from terms (term, side, strong); side near speaks for the continent.

    named: for a country a test of its own that is strong as well.  hint: a country that adds half a point where it has strong
    evidence.  A country without strong evidence is out, whatever its weak terms.
    """
    both = articles.select("ord", F.concat_ws(" ", "title", "description").alias("_text"))
    found = distinct_hits(both, terms.select("term"), ["ord"], "_text").join(terms, "term")
    count = lambda side, strong: F.count_if((F.col("side") == side) & (F.col("strong") == F.lit(strong)))
    sides = ("US", "CA")
    sums = found.groupBy("ord").agg(*(count(s, k).alias(f"_{s}_{k}") for s in sides for k in (True, False)), F.count_if(F.col("side") == "near").alias("_near"))
    tests = articles.select("ord", *(named.get(s, F.lit(False)).alias(f"_named_{s}") for s in sides), (hint if hint is not None else F.lit(None).cast("string")).alias("_hint"))
    rows = tests.join(sums, "ord", "left").na.fill(0)
    strong = {s: F.col(f"_{s}_True") + F.col(f"_named_{s}").cast("int") for s in sides}
    raw = {s: strong[s] + F.col(f"_{s}_False") + F.when(F.col("_hint") == s, 0.5).otherwise(0.0) for s in sides}
    rows = rows.select("ord", "_near", *(F.when(strong[s] > 0, raw[s]).otherwise(0.0).alias(s) for s in sides), (raw["US"] + raw["CA"]).alias("_any"))
    us, ca, top = F.col("US"), F.col("CA"), F.greatest("US", "CA")
    margin = F.when(top > 0, F.abs(us - ca) / top).otherwise(0.0)
    balanced = (us >= 1) & (ca >= 1) & (F.abs(us - ca) <= 1)
    country = F.when(balanced, "US_CA").when((ca > us) & (ca >= 1), "CA").when((us > ca) & (us >= 1), "US").when(F.col("_near") >= 1, "GLOBAL_NA").otherwise("GLOBAL")
    sure = F.when(balanced, 1 - margin).when(top >= 1, margin).when(F.col("_near") >= 1, F.least(F.lit(1.0), F.col("_near") / 2)).when(F.col("_any") == 0, 1.0).otherwise(0.5)
    return rows.select("ord", country.alias("country"), sure.alias("confidence"), us.alias("us"), ca.alias("ca"))


def hubs(articles: DataFrame, terms: DataFrame, least: int = 2) -> DataFrame:
    """(hub, ord, score) of terms (term, hub, negative): twice the distinct hits in the title, plus those in the summary, less twice the negative ones.

    Hits do not overlap: of the terms of one hub the leftmost, and there the longest, stands.  A term and its plural are two hits.
    """
    parts = articles.select("ord", F.lit("t").alias("part"), F.col("title").alias("_text")).unionByName(articles.select("ord", F.lit("s"), F.col("description")).toDF("ord", "part", "_text"))
    found = matches(parts, terms.select("term"), ["ord", "part"], "_text").join(terms, "term")
    keys = ["ord", "part", "hub", "negative"]
    kept = resolved(found.select(*keys, "term", "at", "size", "form"), keys)
    count = lambda test: F.count_distinct(F.when(test, F.col("form")))
    own = ~F.col("negative")
    sums = kept.groupBy("ord", "hub").agg(count(own & (F.col("part") == "t")).alias("_t"), count(own & (F.col("part") == "s")).alias("_s"), count(F.col("negative")).alias("_minus"))
    score = F.greatest(F.lit(0), 2 * F.col("_t") + F.col("_s") - 2 * F.col("_minus"))
    return sums.where(F.col("_t") + F.col("_s") > 0).select("hub", "ord", score.cast("long").alias("score")).where(F.col("score") >= least)


def named(articles: DataFrame, names: DataFrame, aliases: DataFrame, most: int = 8) -> DataFrame:
    """(ord, entities): names (name) and aliases (alias, name) that stand in the title or description, as their canonical names, in the dictionary's order.

    names and aliases carry place, their order; an alias counts as its canonical name, which is there once.
    """
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("description", F.lit("")))
    known = names.select(F.lower("name").alias("term"), "name", "place").unionByName(aliases.select(F.lower("alias").alias("term"), "name", "place"))
    found = distinct_hits(articles.select("ord", text.alias("_text")), known, ["ord"], "_text").join(known, "term")
    once = found.groupBy("ord", F.lower("name").alias("_key")).agg(F.min(F.struct("place", "name")).alias("_first"))
    ranked = once.withColumn("_n", F.row_number().over(W.partitionBy("ord").orderBy("_first"))).where(F.col("_n") <= most)
    listed = ranked.groupBy("ord").agg(F.transform(F.sort_array(F.collect_list("_first")), lambda s: s["name"]).alias("entities"))
    return articles.select("ord").join(listed, "ord", "left").select("ord", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))

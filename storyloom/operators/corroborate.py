"""Details of a story that independent articles share word for word.

A phrase is a name of a member article or a figure in its text.  It is a detail of the story if the texts of
articles from two domains or more contain it, letters of either case alike.  Press releases have no say.

Phrases never meet all texts.  A phrase's words are slots: a word inside the phrase stands whole in every text
that contains the phrase; the first may be the end of a longer word there, the last the beginning of one, a
single word any part.  The vocabulary, not the texts, is searched for such longer words.  Then the slot whose
words are in the fewest texts of the story fetches the texts by an equi-join, and each is verified.

A story shows its first details in the order of members, names before figures.  So the names of its first members are
looked for first; only stories that these leave with fewer details than wanted go on to more members, then to all of them and to figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom.checkpoints import checkpoint
from storyloom.functions import classify
from storyloom.functions.text import col
from storyloom.operators.ordering import top_of_each

MOST_DETAILS = 6
#: Of how many first members of a story the names are looked for before all phrases are; changes the work, not the details.
LOOKS = (16, 256)
# The forms of figures, the years that are none, and the words that make a number no count.
MONEY = r"(?:US|CA|C|A)?\$\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:million|billion|trillion|[mbk]n?))?\b"
AGE = r"\b\d{1,3}-(?:year|month|week|day)-old\b"
PERCENT = r"\b\d[\d.]*(?:\s?%|\s(?:percent|per cent)\b)"
COUNT = r"\d[\d,]*\s+[A-Za-z][A-Za-z-]{2,}\b"
YEAR = r"^(?:1[89]|20)\d{2}$"
NO_COUNT = (
    "the and for are was were has have had will would could should that this with from into over under more most other others than then when who which after before said says new its his her"
    " their per off out not but can may might been being them they against percent"
).split()
#: Longest part of a word that slots are compared by; longer words are cut to overlapping pieces of twice this length.
PART = 64
#: How a slot's word stands in a text's word.
WHOLE, BEGIN, END, WITHIN = range(4)


def figures(text: Column | str) -> Column:
    """Money, ages, percentages and counts in the order of these kinds, word for word; a part of money or of a decimal is no count."""
    found = [F.regexp_extract_all(col(text), F.lit(f"({form})"), 1) for form in (f"(?i){MONEY}", f"(?i){AGE}", f"(?i){PERCENT}", rf"(?<![\w$.,]){COUNT}")]
    number, word = (lambda p: F.regexp_extract(p, r"^[\d,]+", 0)), (lambda p: F.lower(F.regexp_extract(p, "[A-Za-z-]+$", 0)))
    counts = F.filter(found[3], lambda p: ~number(p).rlike(YEAR) & ~word(p).isin(*NO_COUNT))
    return F.concat(*found[:3], counts)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _pieces(word: Column) -> Column:
    """The word itself, or overlapping pieces of a long one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - PART, F.lit(1)), F.lit(PART))
    return F.when(F.length(word) <= 2 * PART, F.array(word)).otherwise(F.transform(starts, lambda i: F.substring(word, i, F.lit(2 * PART))))


def phrases(docs: DataFrame, stories: DataFrame, generic: DataFrame, with_figures: bool = True) -> DataFrame:
    """(grp, key, phrase, at): names first, then figures, each once by its lower-case form, in the order of members; at: its place.

    A phrase in the story's own title is its subject; names that the story displays or that are generic (name) are no details.
    """
    names = docs.select("grp", "ord", F.lit(0).alias("kind"), F.posexplode("entities").alias("pos", "phrase"))
    numbers = docs.select("grp", "ord", F.lit(1).alias("kind"), F.posexplode(figures("whole")).alias("pos", "phrase"))
    rows = (names.unionByName(numbers) if with_figures else names).where(F.length("phrase") >= 2).withColumn("key", F.lower("phrase"))
    place = F.struct("kind", "ord", "pos")
    once = rows.groupBy("grp", "key").agg(F.min_by("phrase", place).alias("phrase"), F.min(place).alias("at"))
    shown = stories.select("grp", F.lower("title").alias("_title"), F.transform("entities", lambda e: F.lower(F.trim(e))).alias("_shown"))
    kept = once.join(shown, "grp").where(~F.contains("_title", "key") & ~((F.col("at.kind") == 0) & F.array_contains("_shown", F.col("key"))))
    plain = generic.select(F.lower(F.trim("name")).alias("_name")).distinct()
    return kept.join(plain, (F.col("at.kind") == 0) & (F.trim("key") == F.col("_name")), "left_anti").select("grp", "key", "phrase", "at")


def containing(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(grp, key, ord) for each phrase (grp, key) and document (grp, ord, lower) of one group that contains it; both are distinct.

    A phrase without letters and digits is contained in nothing.
    """
    words = F.filter(_tokens(F.col("key")), lambda w: w != "")
    slots = wanted.select("grp", "key", F.size(words).alias("_n"), F.posexplode(words).alias("slot", "word"))
    left = (F.col("slot") == 0) & F.col("key").rlike(r"^[\p{L}\p{N}]")
    right = (F.col("slot") == F.col("_n") - 1) & F.col("key").rlike(r"[\p{L}\p{N}]$")
    long = F.length("word") >= PART
    form = F.when((left & right) | long, WITHIN).when(left, END).when(right, BEGIN).otherwise(WHOLE)
    slots = slots.select("grp", "key", "slot", form.alias("form"), F.when(long, F.substring("word", 1, PART - 1)).otherwise(F.col("word")).alias("part"))
    posts = docs.select("grp", "ord", F.explode(F.array_distinct(F.flatten(F.transform(_tokens(F.col("lower")), _pieces)))).alias("piece"))
    lengths = F.broadcast(slots.groupBy("form").agg(F.collect_set(F.length("part")).alias("sizes")))  # PART numbers for each of four forms at most
    size = F.length("piece")
    starts = (
        F.when((F.col("form") == WHOLE) | (F.col("form") == BEGIN), F.array(F.lit(1)))
        .when(F.col("form") == END, F.array(size - F.col("length") + 1))
        .otherwise(F.sequence(F.lit(1), size - F.col("length") + 1))
    )
    fits = (F.col("length") <= size) & ((F.col("form") != WHOLE) | (F.col("length") == size))
    forms = posts.select("piece").distinct().crossJoin(lengths).select("piece", "form", F.explode("sizes").alias("length")).where(fits)
    forms = forms.select("piece", "form", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("piece", i, F.col("length"))))).alias("part"))
    placed = checkpoint(slots.join(forms, ["form", "part"]).select("grp", "key", "slot", "piece"))
    posts = checkpoint(posts.join(placed.select("grp", "piece").distinct(), ["grp", "piece"], "left_semi"))
    df = posts.groupBy("grp", "piece").agg(F.count(F.lit(1)).alias("df"))
    costs = placed.join(df, ["grp", "piece"]).groupBy("grp", "key", "slot").agg(F.sum("df").alias("cost"))
    chosen = costs.groupBy("grp", "key").agg(F.min_by("slot", F.struct("cost", "slot")).alias("slot"))
    fetched = placed.join(chosen, ["grp", "key", "slot"]).join(posts, ["grp", "piece"]).select("grp", "key", "ord").distinct()
    return fetched.join(docs.select("ord", "lower"), "ord").where(F.contains("lower", "key")).select("grp", "key", "ord")


def details(members: DataFrame, stories: DataFrame, generic: DataFrame, most: int = MOST_DETAILS) -> DataFrame:
    """(grp, rank, phrase, domains, sources): the first details of each story; sources in the order of members (grp, ord, ...).

    Null titles and descriptions are empty.  A story without two articles that are no press releases has none.
    """
    release = (F.col("content_type") == "press_release") | classify.from_distributor(F.col("domain"))
    whole = F.trim(F.regexp_replace(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))), r"\s+", " "))
    docs = members.where(~release).select("grp", "ord", "domain", "source", "entities", whole.alias("whole"), F.lower(whole).alias("lower"))
    found, left = None, docs
    for look in (*LOOKS, None):
        first = left if look is None else left.join(top_of_each(left.select("grp", "ord"), ["grp"], [F.asc("ord")], look).select("ord"), "ord", "left_semi")
        told = checkpoint(_told(phrases(first, stories, generic, with_figures=look is None), left, most))
        if look is not None:  # what is missing here comes behind these in the order
            full = told.where(F.col("rank") == most).select("grp")
            told = told.join(full, "grp", "left_semi")
        found = told if found is None else found.unionByName(told)
        if look is not None:
            still = checkpoint(left.select("grp").distinct().join(full, "grp", "left_anti"))
            if still.isEmpty():
                break
            left = left.join(still, "grp", "left_semi")
    return found


def _told(wanted: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """(grp, rank, phrase, domains, sources) of the first of the phrases that texts of two domains contain."""
    wanted = checkpoint(wanted)
    hits = containing(wanted.select("grp", "key"), docs.select("grp", "ord", "lower")).join(docs.select("ord", "domain", "source"), "ord")
    named = hits.groupBy("grp", "key", "domain", "source").agg(F.min("ord").alias("first"))
    by_source = named.groupBy("grp", "key", "source").agg(F.min("first").alias("first"), F.collect_set("domain").alias("domains"))
    order = F.transform(F.sort_array(F.collect_list(F.struct("first", "source"))), lambda s: s["source"])
    told = by_source.groupBy("grp", "key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("domains")))).alias("domains"), order.alias("sources"))
    best = told.where("domains >= 2").join(wanted, ["grp", "key"])
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("grp").orderBy("at")))
    return ranked.where(F.col("rank") <= most).select("grp", "rank", "phrase", "domains", "sources")

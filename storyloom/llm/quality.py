"""Quality rules whose thresholds follow the corpus, in DataFrame operations only.

Each document gets integer measures; ratios are read in thousandths, the mean word length in
tenths.  Counts per language, source, measure and bin form a mergeable quantile sketch: bins are
single numbers up to 64 and above that 32 to each doubling, so that adding counts merges two
sketches, a quantile is off by less than one part in 32, and a sketch of any corpus has a few
hundred bins at most.  The sketches give two quantiles per language and source (QUANTILES); a source with
few documents falls back on its language, a language with few documents on the whole corpus.  A
measure fails beyond the fence ``high + 1.5 * max(high - low, FLOOR)``, and for the word length also
below the mirrored one.  Most documents have no symbols, repeated lines or repeated words, so
quartiles of these are 0 in most groups; their spread is taken from the median to the ninth
decile.  In short texts a ratio says little, so a measure fails only where it also stands above
FREE by count.  Thresholds join back by language and source; a salt spreads a hot source where the
table of thresholds is too large for Spark to broadcast.

Defined results: a null or empty text has no words and fails; a null lang or source is a
group of its own.  Rows that repeat are judged alike, one by one; a null doc_id stays null.  A
text of any length is measured as a whole, within one task.  A bin counts to a quantile as a
whole, so ties need no order.  An empty table gives an empty result.  Other columns stay as they
are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom.llm.common import SPACES, checkpoint, named, text_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: measure -> its low and high quantile, in twentieths; fences lie 1.5 spreads beyond.
QUANTILES = {"symbols": (10, 18), "dup_lines": (10, 18), "repeats": (10, 18), "word_length": (5, 15)}
#: The least spread that counts, in steps.
FLOOR = 2
#: measure -> what no document fails for: symbols, repeated lines, repeated words, characters beyond the fence.
FREE = {"symbols": 2, "dup_lines": 2, "repeats": 20, "word_length": 50}
#: Documents that a group needs for thresholds of its own.
ENOUGH = 50
#: Bits of a number that its bin keeps.
EXACT = 6
SALTS = 32
WINDOW = 5


def _measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns kept, and struct _m with the measures."""
    text = text_of()
    at = lambda array, i: F.get(array, i)
    words = docs.select(
        *keep,
        F.filter(F.split(text, SPACES), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("_symbols"),
    )
    last = F.size("_words") - WINDOW
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hashed = words.select("*", F.transform(places, lambda i: F.xxhash64(*(at(F.col("_words"), i + k) for k in range(WINDOW)))).alias("_hashes"))
    # Without a hash twice no window is there twice; else the windows themselves are compared.
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    window = lambda i: F.struct(F.array_join(F.slice(F.col("_words"), i + 1, WINDOW), " ").alias("w"), i.alias("p"))
    ordered = hashed.select("*", F.when(repeats, F.sort_array(F.transform(places, window))).alias("_windows")).drop("_hashes")
    w = F.col("_windows")
    alike = lambda i, j: F.coalesce(at(w, i)["w"] == at(w, j)["w"], F.lit(False))
    twice = F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.when(alike(i, i + 1) | ((i > 0) & alike(i, i - 1)), at(w, i)["p"])), lambda p: p.isNotNull())
    found = ordered.select("*", F.when(w.isNotNull(), F.sort_array(twice)).alias("_twice")).drop("_windows")
    p = F.col("_twice")
    covered = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(WINDOW), lambda sum, i: sum + F.least(F.lit(WINDOW), at(p, i) - at(p, i - 1)))
    return found.select(
        *keep,
        F.struct(
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            F.col("_symbols").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(F.when(F.size(p) > 1, covered), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
        ).alias("_m"),
    )


def _steps() -> dict[str, Column]:
    ratio = lambda a, b, by: F.expr(f"_m.{a} * {by} div greatest(1, _m.{b})")
    return {
        "symbols": ratio("n_symbols", "word_chars", 1000),
        "dup_lines": ratio("n_dup_lines", "n_lines", 1000),
        "repeats": ratio("n_repeat_words", "n_words", 1000),
        "word_length": ratio("word_chars", "n_words", 10),
    }


def base_failed() -> Column:
    return (F.col("_m.n_words") < 10) | (100 * F.col("_m.n_repeat_words") > 20 * F.col("_m.n_words"))


def _groups() -> list[Column]:
    """lang and source, where null is apart from any string."""
    return [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")).alias(f"_{c}") for c in ("lang", "source")]


def _bin(value: Column) -> Column:
    """The least number of the value's bin: the value with its first EXACT bits alone."""
    rest = F.greatest(F.length(F.bin(value)) - EXACT, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, rest), rest)


def thresholds(measured: DataFrame) -> DataFrame:
    """_lang, _source, and low_* and high_* of every measure, from mergeable sketches."""
    steps = _steps()
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), _bin(v).alias("step")) for k, v in steps.items()))).alias("_v")
    sketch = measured.select(*_groups(), values).groupBy("_lang", "_source", F.col("_v.measure").alias("measure"), F.col("_v.step").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    sketch = checkpoint(sketch)
    levels = {"s": ["_lang", "_source"], "l": ["_lang"], "c": []}
    table = sketch.select("_lang", "_source").distinct()
    for level, by in levels.items():
        merged = sketch.groupBy(*by, "measure", "step").agg(F.sum("n").alias("n"))
        upto = W.partitionBy(*by, "measure").orderBy("step")
        ranked = merged.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(W.partitionBy(*by, "measure")).alias("all"))
        quantiles = ranked.groupBy(*by).agg(
            F.max("all").alias(f"{level}_n"),
            *(F.min(F.when((F.col("measure") == k) & (20 * F.col("upto") >= q * F.col("all")), F.col("step"))).alias(f"{level}_{k}_{q}") for k in steps for q in QUANTILES[k]),
        )
        table = table.join(quantiles, by) if by else table.crossJoin(F.broadcast(quantiles))  # one row
    pick = lambda k, q: F.when(F.col("s_n") >= ENOUGH, F.col(f"s_{k}_{q}")).when(F.col("l_n") >= ENOUGH, F.col(f"l_{k}_{q}")).otherwise(F.col(f"c_{k}_{q}"))
    low, high = lambda k: pick(k, QUANTILES[k][0]), lambda k: pick(k, QUANTILES[k][1])
    spread = lambda k: F.greatest(high(k) - low(k), F.lit(FLOOR))
    return table.select(
        "_lang",
        "_source",
        *((2 * high(k) + 3 * spread(k)).alias(f"high_{k}") for k in steps),
        *((2 * low(k) - 3 * spread(k)).alias(f"low_{k}") for k in steps),
    )


def _judged(measured: DataFrame, keep: list[str], limits: DataFrame) -> DataFrame:
    """The columns kept, _m, and _kept."""
    salted = limits.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = measured.select(*keep, "_m", *_groups(), F.pmod(F.xxhash64("doc_id", F.col("_m.word_chars")), F.lit(SALTS)).cast("int").alias("_salt"))
    counts = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words"}
    within = [(2 * _steps()[k] <= F.col(f"high_{k}")) | (F.col(f"_m.{n}") <= FREE[k]) for k, n in counts.items()]
    # Fences of the word length are in twentieths of a character; beyond counts characters of the whole text.
    chars, n, free = 20 * F.col("_m.word_chars"), F.col("_m.n_words"), 20 * FREE["word_length"]
    within += [chars - F.col("high_word_length") * n <= free, F.col("low_word_length") * n - chars <= free]
    verdict = ~base_failed()
    for test in within:
        verdict = verdict & test
    return rows.join(salted, ["_lang", "_source", "_salt"], "left").select(*keep, "_m", F.coalesce(verdict, F.lit(False)).alias("_kept"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, kept."""
    measured = checkpoint(_measures(docs, ["doc_id", "lang", "source"]))
    return _judged(measured, ["doc_id"], thresholds(measured)).select("doc_id", *(F.col(f"_m.{k}") for k in MEASURES), base_failed().alias("base_failed"), F.col("_kept").alias("kept"))


def apply(docs: DataFrame) -> DataFrame:
    """The documents kept, with their columns. Texts are measured twice rather than written or shuffled."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = F.struct(*(named(c).alias(n) for c, n in zip(docs.columns, names))).alias("_in")
    limits = checkpoint(thresholds(_measures(docs, ["doc_id", "lang", "source"])))
    measured = _measures(docs.select("doc_id", "text", "lang", "source", whole), ["doc_id", "lang", "source", "_in"])
    return _judged(measured, ["_in"], limits).where("_kept").select(*(F.col(f"_in.{n}").alias(c) for n, c in zip(names, docs.columns)))


def sql(table: str = "documents") -> str:
    """DuckDB's form of judge()."""
    ratios = {"symbols": ("n_symbols", "word_chars", 1000), "dup_lines": ("n_dup_lines", "n_lines", 1000), "repeats": ("n_repeat_words", "n_words", 1000), "word_length": ("word_chars", "n_words", 10)}
    step = {k: f"({a} * {by} // greatest(1, {b}))" for k, (a, b, by) in ratios.items()}
    steps = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {v} AS value FROM m" for k, v in step.items())
    quantiles = []
    for level, by in {"s": "lang, source", "l": "lang", "c": ""}.items():
        comma = f"{by}, " if by else ""
        picks = ", ".join(f"min(step) FILTER (measure = '{k}' AND 20 * upto >= {q} * total) AS {level}_{k}_{q}" for k in ratios for q in QUANTILES[k])
        quantiles.append(f"""
{level} AS (SELECT {comma}max(total) AS {level}_n, {picks} FROM (
  SELECT {comma}measure, step, sum(n) OVER (PARTITION BY {comma}measure ORDER BY step) AS upto, sum(n) OVER (PARTITION BY {comma}measure) AS total
  FROM (SELECT {comma}measure, step, count(*) AS n FROM v GROUP BY ALL)) {f"GROUP BY {by}" if by else ""})""")
    pick = lambda k, i: f"CASE WHEN s_n >= {ENOUGH} THEN s_{k}_{QUANTILES[k][i]} WHEN l_n >= {ENOUGH} THEN l_{k}_{QUANTILES[k][i]} ELSE c_{k}_{QUANTILES[k][i]} END"
    spread = lambda k: f"greatest({pick(k, 1)} - {pick(k, 0)}, {FLOOR})"
    high, low = lambda k: f"(2 * {pick(k, 1)} + 3 * {spread(k)})", lambda k: f"(2 * {pick(k, 0)} - 3 * {spread(k)})"
    counts = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words"}
    tests = [f"(2 * {step[k]} <= {high(k)} OR {n} <= {FREE[k]})" for k, n in counts.items()]
    tests += [f"20 * word_chars - {high('word_length')} * n_words <= {20 * FREE['word_length']}", f"{low('word_length')} * n_words - 20 * word_chars <= {20 * FREE['word_length']}"]
    failed = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source,
    coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w : w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l : regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM {table}),
g AS (SELECT r, p, array_to_string(words[p:p + 4], ' ') AS w FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS p FROM t)),
cc AS (SELECT r, p, count(*) OVER (PARTITION BY r, w) AS n FROM g),
k AS (SELECT r, count(DISTINCT x) AS n_repeat_words FROM (SELECT r, unnest(range(p, p + 5)) AS x FROM cc WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines FROM t LEFT JOIN k USING (r)),
v AS (SELECT lang, source, measure, (value >> greatest(length(bin(value)) - {EXACT}, 0)) << greatest(length(bin(value)) - {EXACT}, 0) AS step FROM ({steps})), {", ".join(quantiles)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed,
    NOT {failed} AND {" AND ".join(tests)} AS kept
FROM m JOIN s USING (lang, source) JOIN l USING (lang) CROSS JOIN c
"""

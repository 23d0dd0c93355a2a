"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom import config

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēėęěğīįłńňōőřśşšťūůűųźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiilnnoorssstuuuuzzz"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def without_accents(text: Column | str) -> Column:
    """Lower-case Latin letters without their marks."""
    return F.regexp_replace(F.translate(col(text), _ACCENTED, _PLAIN), "[̀-ͯ]", "")


def slugify(text: Column | str, longest: int = 80) -> Column:
    plain = F.regexp_replace(without_accents(F.lower(col(text))), "['’]", "")
    slug = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, longest), "-+$", "")
    return F.when(slug == "", F.lit("story")).otherwise(slug)


def stable_id(text: Column | str, length: int = 12) -> Column:
    return F.substring(F.sha2(col(text).cast("binary"), 256), 1, length)


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a over the characters, as eight hex digits."""
    codes = F.transform(F.filter(F.split(col(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(1 << 32))
    return F.lower(F.lpad(F.hex(F.aggregate(codes, F.lit(2166136261).cast("long"), step)), 8, "0"))


def tokens(text: Column | str, stopwords: tuple[str, ...] = config.STOPWORDS) -> Column:
    """Significant words in order: lower case, split at what is not a-z or 0-9, two characters or more, no stop words."""
    words = F.split(F.regexp_replace(F.lower(col(text)), "['’]", ""), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))


def bigrams(words: Column) -> Column:
    """Distinct neighbouring pairs."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def truncate(text: Column | str, longest: int) -> Column:
    """Cut at a word if one ends late enough, with an ellipsis."""
    text = col(text)
    cut = F.substring(text, 1, longest)
    space = F.length(cut) - F.locate(" ", F.reverse(cut))  # place of the last space, or the length
    at = F.when(F.locate(" ", cut) == 0, F.lit(longest)).when(space > longest * 0.6, space).otherwise(F.lit(longest))
    return F.when(F.length(text) <= longest, text).otherwise(F.concat(F.rtrim(F.substring(cut, F.lit(1), at)), F.lit("…")))


def meta_description(text: Column | str, longest: int = 155) -> Column:
    """Whole sentences while they fit, else a cut at a word."""
    clean = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    # What fits ends within the first characters; the pattern need not see more.
    sentences = F.regexp_extract_all(F.substring(clean, 1, longest + 2), F.lit("[^.!?]+(?:[.!?]+[\"')\\]]*\\s+|[.!?]+$)"), 0)
    start = F.struct(F.lit("").alias("out"), F.lit(True).alias("open"))

    def step(state, s):
        next_ = F.rtrim(F.concat(state["out"], s))
        fits = state["open"] & (F.length(next_) <= longest)
        return F.struct(F.when(fits, F.concat(next_, F.lit(" "))).otherwise(state["out"]).alias("out"), fits.alias("open"))

    kept = F.trim(F.aggregate(sentences, start, step)["out"])
    short = F.regexp_replace(truncate(clean, longest), "[\\s,;:–—-]+…$", "…")
    return F.when(F.length(clean) <= longest, clean).when(kept != "", kept).otherwise(short)


def _undouble(stem: Column, pattern: str) -> Column:
    return F.when(stem.rlike(pattern), F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem)


def stem(word: Column) -> Column:
    """The stem that stories are matched by: plural, gerund or past tense, adverb, final e."""
    cut = lambda w, n, end="": F.concat(F.substring(w, F.lit(1), F.length(w) - n), F.lit(end))
    doubled = r"([bcdfghjkmnpqrtvwxy])\1$"
    w = word
    plural = (
        F.when(w.endswith("ies") & (F.length(w) >= 5), cut(w, 3, "y"))
        .when(w.endswith("sses"), cut(w, 2))
        .when(w.endswith("ss") | w.endswith("us") | w.endswith("is"), w)
        .when(w.endswith("s"), cut(w, 1))
        .otherwise(w)
    )
    bind = lambda value, f: F.transform(F.array(value), f)[0]
    tense = lambda w: (
        F.when(w.endswith("ing") & (F.length(w) >= 6), _undouble(cut(w, 3), doubled))
        .when(w.endswith("ied") & (F.length(w) >= 5), cut(w, 3, "y"))
        .when(w.endswith("ed") & (F.length(w) >= 5), _undouble(cut(w, 2), doubled))
        .otherwise(w)
    )
    adverb = lambda w: F.when(w.endswith("ly") & (F.length(w) >= 6), cut(w, 2)).otherwise(w)
    final = lambda w: F.when(w.endswith("e") & (F.length(w) >= 4), cut(w, 1)).otherwise(w)
    return F.when(F.length(word) <= 3, word).otherwise(bind(bind(bind(plural, tense), adverb), final))


def title_stem(word: Column) -> Column:
    """The lighter stem that two titles are compared by."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    doubled = r"([bdglmnprt])\1$"
    return (
        F.when((F.length(word) > 5) & word.endswith("ing"), _undouble(cut(3), doubled))
        .when((F.length(word) > 4) & word.endswith("ed"), _undouble(cut(2), doubled))
        .when((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


def title_tokens(title: Column | str) -> Column:
    words = F.transform(F.split(F.lower(col(title)), "[^a-z0-9']+"), lambda w: F.regexp_replace(w, "'", ""))
    words = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*config.TITLE_STOPWORDS))
    return F.array_distinct(F.transform(words, title_stem))


def title_similarity(a: Column | str, b: Column | str) -> Column:
    return jaccard(title_tokens(a), title_tokens(b))


def strip_html(html: Column | str) -> Column:
    """Text of a fragment: block ends as line ends, tags as spaces, entities decoded, white space collapsed."""
    steps = [
        (r"(?is)<(script|style)\b.*?</\1>", " "),
        (r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>", "\n"),
        (r"<[^>]*>", " "),
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;|&apos;", "'"),
        ("&nbsp;", " "),
        (r"[ \t\r\f]+", " "),
        (r" ?\n ?", "\n"),
        (r"\n+", "\n"),
    ]
    return F.trim(F.regexp_replace(reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, col(html)), r"^\n|\n$", ""))


def xml_escape(text: Column | str) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, col(text))


def sentences(text: Column | str) -> Column:
    return F.filter(F.split(col(text), "(?<=[.!?…])\\s+|\n+"), lambda s: s != "")


def shouted(text: Column | str) -> Column:
    """More than 80 characters, nine tenths of the letters in upper case."""
    letters = F.regexp_count(col(text), F.lit(r"\p{L}"))
    return (F.length(col(text)) > 80) & (letters > 0) & (F.regexp_count(col(text), F.lit(r"\p{Lu}")) > 0.9 * letters)


def numeric_phrases(text: Column | str) -> Column:
    """Money, ages, percentages and counts."""
    forms = [r"[$€£]\d[\d,.]*(?: (?:million|billion))?", r"\d+-year-old", r"\d+(?:\.\d+)?(?:%| percent)", r"\b\d{1,3}(?:,\d{3})+\b"]
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(col(text), F.lit(f), 0) for f in forms))))


def duration(minutes: Column) -> Column:
    """47 min, 3h 18m, 2d 3h."""
    m = minutes.cast("long")
    hours, days = F.floor(m / 60), F.floor(m / 1440)
    return (
        F.when(m < 60, F.concat(m.cast("string"), F.lit(" min")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h"), F.when(m % 60 > 0, F.concat(F.lit(" "), (m % 60).cast("string"), F.lit("m"))).otherwise("")))
        .otherwise(F.concat(days.cast("string"), F.lit("d"), F.when(hours % 24 > 0, F.concat(F.lit(" "), (hours % 24).cast("string"), F.lit("h"))).otherwise("")))
    )


def counted(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many or one + "s")))


def normalised_topic(name: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(without_accents(F.lower(col(name))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def topic_key(name: Column | str) -> Column:
    """The key that spellings of one topic share: no marks, no trailing kind of place, singular last word."""
    bare = F.regexp_replace(normalised_topic(name), r" (city|county|province|state|region|district|republic|kingdom|territory|island)$", "")
    last = F.regexp_replace(F.regexp_replace(bare, r"ies$", "y"), r"([^s])s$", "$1")
    return slugify(last, 60)


def id_token(slug: Column | str) -> Column:
    return F.substring_index(col(slug), "-", -1)


def topic_name(name: Column | str) -> Column:
    """Lower case without marks and apostrophes, words apart by one space: what two spellings of a topic are compared by."""
    return F.trim(F.regexp_replace(F.regexp_replace(without_accents(F.lower(col(name))), "['’]", ""), "[^a-z0-9]+", " "))


def plural_variants(word: Column) -> Column:
    """array<string>: how the plural or the singular of a word may be spelled; never the word itself, nor less than three letters."""
    cut = lambda n, end="": F.concat(F.substring(word, F.lit(1), F.length(word) - n), F.lit(end))
    forms = F.array(
        F.concat(word, F.lit("s")),
        F.when(word.rlike("[^aeiou]y$"), cut(1, "ies")),
        F.when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))),
        F.when((F.length(word) > 4) & word.endswith("ies"), cut(3, "y")),
        F.when((F.length(word) > 4) & word.rlike("(ses|xes|zes|ches|shes)$"), cut(2)),
        F.when((F.length(word) > 3) & word.rlike("[^s]s$"), cut(1)),
    )
    return F.array_distinct(F.filter(forms, lambda f: f.isNotNull() & (F.length(f) > 2)))

"""RSS and Atom bodies as rows, and what a feed scan says about its feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom.functions import text


def tag(block: Column, name: str) -> Column:
    """Text of the first such element, CDATA unwrapped; null where there is none."""
    body = F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    bare = F.trim(F.regexp_replace(body, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))
    return F.when(bare != "", bare)


def attribute(element: Column, name: str) -> Column:
    found = F.regexp_extract(element, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when(found != "", found)


def usable_image(url: Column) -> Column:
    return url.rlike("(?i)^https://") & ~url.rlike(r"(?i)(/pixel|/beacon|1x1)")


def image(block: Column) -> Column:
    """The widest media picture, else a thumbnail, an enclosure, the item's own image, the first usable one in the text."""
    media = F.transform(
        F.regexp_extract_all(block, F.lit(r"(?is)<media:content\b[^>]*>"), 0),
        lambda m: F.struct(F.coalesce(attribute(m, "width").try_cast("int"), F.lit(0)).alias("width"), attribute(m, "url").alias("url")),
    )
    widest = F.array_max(F.filter(media, lambda m: usable_image(m["url"])))["url"]
    first = lambda form, key: F.filter(F.transform(F.regexp_extract_all(block, F.lit(form), 0), lambda m: attribute(m, key)), usable_image)
    own = F.filter(F.array(F.coalesce(tag(tag(block, "image"), "url"), tag(block, "image"))), usable_image)
    drawn = F.filter(F.regexp_extract_all(F.regexp_replace(F.regexp_replace(block, "&lt;", "<"), "&gt;", ">"), F.lit(r"(?is)<img\b[^>]*>"), 0), lambda m: ~m.rlike(r"(?i)(width|height)=[\"']?1[\"'\s>]"))
    drawn = F.filter(F.transform(drawn, lambda m: attribute(m, "src")), usable_image)
    return F.coalesce(widest, *(F.get(x, 0) for x in (first(r"(?is)<media:thumbnail\b[^>]*>", "url"), first(r"(?is)<enclosure\b[^>]*type=[\"']image[^>]*>", "url"), own, drawn)))


def when(block: Column) -> Column:
    raw = F.coalesce(tag(block, "pubDate"), tag(block, "published"), tag(block, "updated"), tag(block, "dc:date"))
    named = F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC|UT|Z)$", "+0000")
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z"]
    iso = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd"]
    return F.coalesce(*(F.try_to_timestamp(named, F.lit(f)) for f in forms), *(F.try_to_timestamp(raw, F.lit(f)) for f in iso))


def items(feeds: DataFrame, most: int = 100) -> DataFrame:
    """Rows (feed_url, ord, title, description, url, published_at, image_url, accepted) of feeds (feed_url, xml), at most so many of each."""
    rss = F.regexp_extract_all("xml", F.lit(r"(?is)<item\b[^>]*>.*?</item>"), 0)
    atom = F.regexp_extract_all("xml", F.lit(r"(?is)<entry\b[^>]*>.*?</entry>"), 0)
    blocks = F.slice(F.when(F.size(rss) > 0, rss).otherwise(atom), 1, most)
    block = F.col("block")
    link = F.coalesce(tag(block, "link"), attribute(F.regexp_extract(block, r"(?is)<link\b[^>]*>", 0), "href"), tag(block, "guid"))
    parsed = feeds.select("feed_url", F.posexplode(blocks).alias("ord", "block")).select(
        "feed_url",
        "ord",
        text.strip_html(tag(block, "title")).alias("title"),
        text.strip_html(F.coalesce(tag(block, "description"), tag(block, "summary"), tag(block, "content"))).alias("description"),
        link.alias("url"),
        when(block).alias("published_at"),
        image(block).alias("image_url"),
    )
    return parsed.withColumn("accepted", F.col("title").isNotNull() & (F.col("title") != "") & F.col("url").isNotNull() & F.col("published_at").isNotNull())


def health(feeds: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row for each feed, in the order given: ok, items_parsed, items_skipped."""
    counts = parsed.groupBy("feed_url").agg(F.count_if("accepted").alias("parsed"), F.count_if(~F.col("accepted")).alias("skipped"))
    out = feeds.join(counts, "feed_url", "left").select("feed_url", F.coalesce("parsed", F.lit(0)).alias("items_parsed"), F.coalesce("skipped", F.lit(0)).alias("items_skipped"))
    return out.withColumn("ok", F.col("items_parsed") > 0)


def catalogue(extra: DataFrame, curated: DataFrame) -> DataFrame:
    """Feeds given for this run first, then curated ones that are not among them. Both: ord, feed_url."""
    both = extra.select(F.lit(0).alias("rank"), "ord", "feed_url").unionByName(curated.select(F.lit(1).alias("rank"), "ord", "feed_url"))
    key = F.regexp_replace(F.lower(F.trim("feed_url")), "/+$", "")
    first = W.partitionBy(key).orderBy("rank", "ord")
    return both.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("rank", "ord", "feed_url")


def union_isolated(parts: dict) -> tuple[DataFrame | None, list[tuple[str, str, str]]]:
    """Union of sources given as {name: function}; one that fails is reported and left out."""
    frames, status = [], []
    for name, read in parts.items():
        try:
            frame = read()
            frame.schema  # noqa: B018  analysis happens here
        except Exception as error:  # a source's failure is a row of the report
            status.append((name, "failed", str(error).splitlines()[0][:200]))
        else:
            frames.append(frame.withColumn("provider", F.lit(name)))
            status.append((name, "ok", ""))
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out, status
